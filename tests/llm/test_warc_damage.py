"""Archives after damage: every other page keeps its own id; headers without a length; null and repeated ids; hot digests."""

from __future__ import annotations

import gzip
import os

import pytest
from pyspark.sql import functions as F

from fathom.llm import scratch, warc

KIND = "page_id long, url string, html string, file string, place int"


def pages(spark, n=8):
    return spark.createDataFrame([(i, f"http://x.org/{i}", f"<p>{i}</p>" * (i + 1), "f", 1) for i in range(n)], KIND).coalesce(1)


def written(spark, tmp_path, version, spoil):
    """Pages through ARC files that ``spoil`` (bytes -> bytes) has changed, and what is read back."""
    folder = f"file://{tmp_path}/a"
    index = scratch.table(warc.write_arc(pages(spark), f"{folder}/arc", version), "index")
    for name in os.listdir(f"{tmp_path}/a/arc"):
        if name.endswith(".gz"):
            path = f"{tmp_path}/a/arc/{name}"
            data = open(path, "rb").read()
            open(path, "wb").write(spoil(data))
    plan = scratch.table(warc.plan_revisits(index), "plan")
    files = scratch.table(warc.convert_archives(plan, f"{folder}/arc", f"{folder}/warc"), "files")
    found = {r["page_id"]: r for r in warc.read_archives(files, f"{folder}/warc").collect()}
    assert all(r["url"] == f"http://x.org/{i}" and r["payload_digest"] == warc.digest((f"<p>{i}</p>" * (i + 1)).encode()) for i, r in found.items())
    return set(found), files.first()


def starts(data):
    return [at for at, _ in warc.members(data)]


@pytest.mark.parametrize("version", [1, 2])
def test_a_broken_header_line_costs_one_page(spark, tmp_path, version):
    def spoil(data):
        at = [*starts(data), len(data)]
        record = gzip.decompress(data[at[3] : at[4]])  # behind the file's own record and pages 0 and 1
        for level in range(10):  # a member of the same size, so that the others stay where they are
            for tail in range(200):
                packed = gzip.compress(record.replace(b"20240101000000", b"no date at all")[: len(record) - tail], level)
                if len(packed) == at[4] - at[3]:
                    return data[: at[3]] + packed + data[at[4] :]
        raise AssertionError

    found, told = written(spark, tmp_path, version, spoil)
    assert found == {0, 1, 3, 4, 5, 6, 7} and (told["damaged"], told["planned"], told["written"]) == (1, 8, 7)


@pytest.mark.parametrize("version", [1, 2])
def test_a_broken_member_costs_one_page(spark, tmp_path, version):
    def spoil(data):
        at = starts(data)[3] + 14
        return data[:at] + bytes(b ^ 0xFF for b in data[at : at + 6]) + data[at + 6 :]

    found, told = written(spark, tmp_path, version, spoil)
    assert found == {0, 1, 3, 4, 5, 6, 7} and told["damaged"] >= 1 and told["written"] == 7


def test_the_files_own_record_lost_and_the_end_cut_off(spark, tmp_path):
    def spoil(data):
        return data[:12] + b"\x00\x00\x00" + data[15:-60]

    found, told = written(spark, tmp_path, 2, spoil)
    assert found == {0, 1, 2, 3, 4, 5, 6} and told["damaged"] >= 2


def test_many_records_in_a_member():
    records = [warc.arc_record(f"http://x.org/{i}", "1.2.3.4", "20010203040506", "text/html", b"<p>%d</p>" % i) for i in range(5)]
    whole = warc.arc_preamble("n") + b"".join(records)
    got = list(warc.arc_records(gzip.compress(whole)))
    assert [f["url"] for _, f, _ in got] == [f"http://x.org/{i}" for i in range(5)] and len({p for p, _, _ in got}) == 5
    damage = warc.Damage()
    broken = list(warc.arc_records(gzip.compress(whole.replace(b"x.org/2 ", b"x.org/2 more fields that are not there ", 1).replace(b"20010203040506 text/html 8\n<p>2", b"nodate text/html 8\n<p>2")), damage))
    assert {f["url"][-1] for _, f, _ in broken} == set("0134") and damage.n == 1


def test_revisits_of_chunked_responses():
    header = {"url": "u", "ip": "1.2.3.4", "date": "20010203040506", "type": "text/html"}
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nabcdef"
    ((fields, body),) = warc.warc_records(gzip.compress(warc.convert(header, block, 1, 2, True)))
    assert warc._size(fields, warc.split_http(body)[0]) == 6
    assert warc._size({}, b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\n") == 9 and warc._size({}, b"HTTP/1.1 200 OK\r\n\r\n") is None


def test_null_repeated_and_very_long(spark, tmp_path, monkeypatch):
    rows = [(None, "http://a", "x", "f", 1), (3, None, None, "f", 1), (3, "http://b c", None, "f", 1), (3, "http://d", "y" * 3_000_000, "f", 1), (7, "http://e", "y" * 3_000_000, "f", 1), (8, "http://f", "", "f", 1)]
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.op10_warc(spark, str(tmp_path)).collect()), key=str)
    empty = [x for x in got if x[1] == 0]
    assert len(got) == 6 and sorted(x[2] for x in empty) == ["response", "revisit", "revisit"] and all(x[3] == 8 for x in empty if x[2] == "revisit")
    assert (None, 1, "response", None) in got and (7, 3_000_000, "response", None) in got and (3, 3_000_000, "revisit", 7) in got
    plain = warc.read_archives
    monkeypatch.setattr(warc, "read_archives", lambda files, folder: plain(files, folder).where(F.col("page_id") != 7))
    with pytest.raises(ValueError, match="read back"):
        warc.op10_warc(spark, str(tmp_path))
