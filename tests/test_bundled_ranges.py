"""Small ranges share a task: the number of tasks follows the bytes, not the size of the ranges."""

import io
import random
import re

from veilframe.functions.encoding import LINE, printable_share
from veilframe.sources import text_ranges
from veilframe.sources.text_ranges import Range, Reader, raw_lines, scan_lines


def test_ranges_share_tasks(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    want = set()
    for k in range(6):
        text = "".join(rng.choice(["word ", "é", "\n", "\r\n", "\r", "x" * 700]) for _ in range(900))
        (tmp_path / f"{k}.txt").write_bytes(text.encode())
        want |= {(f"{k}.txt", n, line) for n, line in enumerate(re.findall(LINE, text), 1)}
    (tmp_path / "empty.txt").write_bytes(b"")
    options = {"path": str(tmp_path), "rangebytes": "512", "taskbytes": "100000"}
    size, single = sum(f.stat().st_size for f in tmp_path.iterdir()), Reader(options | {"taskbytes": "0"}).partitions()
    shared = Reader(options).partitions()
    assert len(single) > size // 520 and len(shared) <= size // 90_000 + 1
    assert [r for p in shared for r in p.ranges] == single
    # 1,500 tasks and more, where one is enough
    lines = scan_lines(spark, str(tmp_path), 512)
    assert lines.select("file").rdd.getNumPartitions() < 20
    assert {(r["file"], r["line_no"], r["line"]) for r in lines.collect()} == want
    monkeypatch.setattr(text_ranges, "TASK_BYTES", 3_000)
    assert {(r["file"], r["line_no"], r["line"]) for r in scan_lines(spark, str(tmp_path), 512).collect()} == want


class Counted(io.BytesIO):
    bytes_read = 0

    def read(self, n=-1):
        out = super().read(n)
        self.bytes_read += len(out)
        return out


def test_ranges_inside_of_a_line_don_t_read_to_its_end():
    content = b"first\n" + b"x" * 4_000_000 + b"\nlast\n"
    read, lines = 0, []
    for k, start in enumerate(range(0, len(content), 64 << 10)):
        stream = Counted(content)
        lines += [x for raw in raw_lines(Range("", "", k, start, min(start + (64 << 10), len(content)), len(content), "utf-8", 0), stream) for x in re.findall(LINE.encode(), raw)]
        read += stream.bytes_read
    assert lines == content.splitlines(keepends=True)
    assert read < 5 * len(content)  # 30 times as much, once


def test_printable_share():
    for text in ("", "plain\r\n\t", "a\x00b\x01\x00é", "\x0b" * 5, "日𝄞\u0081"):
        assert printable_share(text) == (sum(c.isprintable() or c in "\r\n\t" for c in text) / len(text) if text else 1.0)
