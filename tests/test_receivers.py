"""A TCP server's bytes as a stream: none are lost when the connection or the query ends."""

import select
import socket
import threading
import time

from test_engine import boots

from logweave.sources import wire
from logweave.streaming import live
from logweave.streaming.receivers import Landing, TcpReceiver, VehicleReceiver


class Server(threading.Thread):
    """Sends pieces one after another; closes the connection after every fourth."""

    def __init__(self, pieces):
        super().__init__(daemon=True)
        self.pieces, self.sock, self.go = pieces, socket.create_server(("127.0.0.1", 0)), threading.Semaphore(0)
        self.port, self.conn = self.sock.getsockname()[1], None

    def left_alone(self):
        """Whether the other side has closed the connection that the server waits on."""
        try:
            return bool(select.select([self.conn], [], [], 0)[0])
        except (OSError, ValueError):
            return False

    def run(self):
        while self.pieces:
            conn, _ = self.sock.accept()
            self.conn = conn
            with conn:
                for _ in range(4):
                    if not self.pieces:
                        break
                    self.go.acquire()
                    if select.select([conn], [], [], 0)[0]:  # the other side has gone: send to the next one
                        self.go.release()
                        break
                    conn.sendall(self.pieces.pop(0))
                else:
                    conn.shutdown(socket.SHUT_WR)
                    conn.recv(1)


def wait_for(test, seconds=40):
    until = time.monotonic() + seconds
    while not test() and time.monotonic() < until:
        time.sleep(0.2)
    return test()


def test_landing_goes_on_where_it_ended(tmp_path):
    raw = [bytes([i]) * 50 for i in range(9)]
    server = Server(list(raw))
    server.start()
    for _ in raw:
        server.go.release()
    one = TcpReceiver("127.0.0.1", server.port, Landing(str(tmp_path)), seconds=0.1, retry=0.05)
    one.start()
    landing = Landing(str(tmp_path))
    got = lambda: b"".join(r[3] for n in range(landing.count()) for r in landing.read(n))
    assert wait_for(lambda: len(got()) == 450) and got() == b"".join(raw)
    one.stop()
    one.join(5)
    two = TcpReceiver("127.0.0.1", server.port, Landing(str(tmp_path)))
    seqs = [r[2] for n in range(landing.count()) for r in landing.read(n)]
    assert two.landed == landing.count() and seqs == list(range(len(seqs))) and two.seq == len(seqs)


def test_messages_of_a_server_survive_a_restart(spark, tmp_path):
    msgs = boots()[:150]
    whole = b"".join(wire.write(m)[16:] for m in msgs)
    pieces = [whole[i : i + 333] for i in range(0, len(whole), 333)]
    half = len(pieces) // 2 // 4 * 4 + 2  # in the middle of a connection
    server = Server(list(pieces))
    server.start()
    spark.dataSource.register(VehicleReceiver)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def start():
        rows = spark.readStream.format("vehiclereceiver").options(host="127.0.0.1", port=str(server.port), folder=str(tmp_path / "landed"), seconds="0.2", max_files="3").load()
        return live.messages(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(processingTime="300 milliseconds").start()

    schema = "index long, payload binary"

    def seen():
        try:
            return spark.read.schema(schema).parquet(out).count()
        except Exception:  # nothing was written yet
            return 0

    q = start()
    for _ in range(half):
        server.go.release()
    landing = Landing(str(tmp_path / "landed"))
    assert wait_for(lambda: sum(len(r[3]) for n in range(landing.count()) for r in landing.read(n)) == 333 * half)
    assert wait_for(lambda: seen() > 40)
    q.stop()
    assert wait_for(server.left_alone)
    for _ in pieces:
        server.go.release()
    q = start()
    try:
        assert wait_for(lambda: seen() >= len(msgs))
    finally:
        q.stop()
    got = spark.read.schema(schema).parquet(out).orderBy("index").collect()
    assert [bytes(r["payload"]) for r in got] == [m.payload for m in msgs]
