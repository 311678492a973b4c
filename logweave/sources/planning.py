"""Driver-side planning: paths, archives, probing, grouping files to streams."""

from __future__ import annotations

import bz2
import fnmatch
import glob
import gzip
import io
import lzma
import os
import re
import tarfile
import tempfile
import zipfile
from dataclasses import dataclass
from pathlib import Path

from . import datasource, wire

PROBE_BYTES = 512 * 1024
ARCHIVES = (".zip", ".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tar.xz", ".gz", ".bz2", ".xz")


class Chain(io.RawIOBase):
    """Parts of a multi-volume file as one that can seek."""

    def __init__(self, paths: list[str]):
        self.paths, self.sizes = paths, [os.path.getsize(p) for p in paths]
        self.at, self.total = 0, sum(self.sizes)

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = max(0, offset + (0, self.at, self.total)[whence])
        return self.at

    def tell(self) -> int:
        return self.at

    def readinto(self, into) -> int:
        start = 0
        for path, size in zip(self.paths, self.sizes, strict=True):
            if start <= self.at < start + size:
                with open(path, "rb") as f:
                    f.seek(self.at - start)
                    got = f.read(min(len(into), size - (self.at - start)))
                into[: len(got)] = got
                self.at += len(got)
                return len(got)
            start += size
        return 0


def volumes(path: str) -> list[str]:
    """All volumes of 'name.zip.001', in order; the path itself if it has none."""
    m = re.fullmatch(r"(.*\.(?:zip|7z))\.(\d{3,})", path, re.I)
    if not m:
        return [path]
    found = [p for p in glob.glob(glob.escape(m[1]) + ".*") if re.fullmatch(r"\d{3,}", p[len(m[1]) + 1 :])]
    return sorted(found, key=lambda p: int(p.rsplit(".", 1)[1]))


def _zip(path: str) -> zipfile.ZipFile:
    parts = volumes(path)
    return zipfile.ZipFile(io.BufferedReader(Chain(parts)) if len(parts) > 1 else path)


def is_archive(path: str) -> bool:
    low = path.lower()
    return low.endswith(ARCHIVES) or bool(re.search(r"\.zip\.\d{3,}$", low))


def entries(path: str) -> list[str]:
    """Files in an archive; a compressed single file has one, named after it."""
    low = path.lower()
    if low.endswith(".zip") or re.search(r"\.zip\.\d{3,}$", low):
        with _zip(path) as z:
            return [i.filename for i in z.infolist() if not i.is_dir()]
    if low.endswith((".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tar.xz")):
        with tarfile.open(path) as t:
            return [m.name for m in t.getmembers() if m.isfile()]
    return [Path(path).stem]


def open_entry(path: str, entry: str) -> bytes:
    low = path.lower()
    if low.endswith(".zip") or re.search(r"\.zip\.\d{3,}$", low):
        with _zip(path) as z:
            return z.read(entry)
    if low.endswith((".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tar.xz")):
        with tarfile.open(path) as t:
            return t.extractfile(entry).read()
    opener = {".gz": gzip.open, ".bz2": bz2.open, ".xz": lzma.open}[os.path.splitext(low)[1]]
    with opener(path) as f:
        return f.read()


def extract(path: str, pattern: str = "**", target: str | None = None) -> list[str]:
    """Extracts the matching entries to target (a new temporary folder); files that are there already are used again."""
    target = target or tempfile.mkdtemp(prefix="logweave-")
    out = []
    for e in entries(path):
        if pattern not in ("**", "**/*") and not fnmatch.fnmatch(e, pattern.replace("**/", "*")) and not fnmatch.fnmatch(Path(e).name, pattern.removeprefix("**/")):
            continue
        to = (Path(target) / e).resolve()
        if not to.is_relative_to(Path(target).resolve()):
            continue  # an entry may not leave the folder
        if not to.exists():
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_bytes(open_entry(path, e))
        out.append(str(to))
    return out


def listing(path: str, folder: str = "") -> list[tuple[str, str]]:
    """(name, 'dir' or 'file') of one level in an archive; folders without entries of their own are implied."""
    prefix, out = folder.strip("/") + "/" if folder.strip("/") else "", {}
    for e in entries(path):
        if e.startswith(prefix):
            name, _, more = e[len(prefix) :].partition("/")
            out[name] = "dir" if more else "file"
    return sorted(out.items())


def stat(path: str) -> dict:
    """Size, time and kind of a path; 'archive!/entry' looks inside."""
    outer, _, inner = path.partition("!/")
    s = os.stat(outer)
    if not inner:
        return {"size": s.st_size, "mtime": int(s.st_mtime), "type": "dir" if os.path.isdir(outer) else "file"}
    names = entries(outer)
    kind = "file" if inner in names else "dir" if any(n.startswith(inner.rstrip("/") + "/") for n in names) else None
    if kind is None:
        raise FileNotFoundError(path)
    return {"size": len(open_entry(outer, inner)) if kind == "file" else 0, "mtime": int(s.st_mtime), "type": kind}


def read_dir(path: str) -> list[tuple[str, str]]:
    outer, bang, inner = path.partition("!/")
    if bang or is_archive(outer) and os.path.isfile(outer):
        return listing(outer, inner)
    return sorted((e.name, "dir" if e.is_dir() else "file") for e in os.scandir(path))


def files_with_ext(folder: str, ext: str, recursive: bool = False) -> list[str]:
    """Files by extension, in either case; linked folders are not entered and unreadable ones are passed over."""
    out = []
    try:
        found = sorted(os.scandir(folder), key=lambda e: e.name)
    except OSError:
        return out
    for e in found:
        if e.is_file() and e.name.lower().endswith("." + ext.lower().lstrip(".")):
            out.append(e.path)
        elif recursive and e.is_dir(follow_symlinks=False):
            out += files_with_ext(e.path, ext, True)
    return out


@dataclass(frozen=True)
class Probe:
    path: str
    size: int
    mtime: int
    first: wire.Message | None
    ecus: frozenset[bytes]


def probe(path: str) -> Probe:
    """The first message and the ECUs in the first half megabyte."""
    with open(path, "rb") as f:
        raw = f.read(PROBE_BYTES)
    first, ecus = None, set()
    for msg in datasource.read_messages(raw, path):
        first = first or msg
        ecus.add(msg.ecu)
    s = os.stat(path)
    return Probe(path, s.st_size, int(s.st_mtime), first, frozenset(ecus))


def resolve(names: list[str]) -> list[str]:
    """Existing paths as they are, else patterns in either case, 'archive!/pattern' extracted; files without messages are left out."""
    out: list[str] = []
    for name in names:
        outer, bang, inner = name.partition("!/")
        if bang or is_archive(name) and os.path.exists(name):
            out += extract(outer, inner or "**")
        elif os.path.exists(name):
            out.append(os.path.realpath(name))
        else:
            folder = os.path.dirname(name) or "."
            pattern = re.compile(fnmatch.translate(os.path.basename(name)), re.I)
            out += [os.path.realpath(e.path) for e in sorted(os.scandir(folder), key=lambda e: e.name) if pattern.match(e.name)]
    return [p for p in out if probe(p).first is not None]


def streams(paths: list[str]) -> list[list[str]]:
    """Files with the same set of ECUs are one stream, in the order of their first reception; equal paths once."""
    groups: dict[frozenset[bytes], list[Probe]] = {}
    for p in map(probe, dict.fromkeys(paths)):
        if p.first is not None:
            groups.setdefault(p.ecus, []).append(p)
    order = lambda p: (p.first.reception_time_us, p.path)
    return [[p.path for p in sorted(g, key=order)] for g in sorted(groups.values(), key=lambda g: min(map(order, g)))]
