"""Row transformers applied in order: each is a function of the message table.

`chain` applies several; a transformer may rewrite text, add headers or drop rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Plugin = Callable[[DataFrame], DataFrame]


def chain(msgs: DataFrame, plugins: list[Plugin]) -> DataFrame:
    for p in plugins:
        msgs = msgs.transform(p)
    return msgs


def from_config(config: dict) -> Plugin | None:
    """A transformer by its configuration's name; None if it is disabled."""
    from . import anonymize, can, model_decode, non_verbose, rewrite, someip, state

    makers = {
        "Rewrite": lambda c: rewrite.from_config(c),
        "Anonymize": lambda c: anonymize.anonymize,
        "NonVerbose": lambda c: non_verbose.from_dir(c["fibexDir"]),
        "Muniic": lambda c: model_decode.from_dir(c["jsonDir"]),
        "FileTransfer": lambda c: state.Transfers(c),
        "Export": lambda c: state.Export(c),
        "SomeIp": lambda c: someip.from_config(c),
        "CAN": lambda c: can.from_dir(c["fibexDir"]),
    }
    if config.get("name") not in makers:
        raise ValueError(f"unknown plugin {config.get('name')!r}")
    return makers[config["name"]](config) if config.get("enabled", True) else None
