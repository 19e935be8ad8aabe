import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lexmill.llm import warc


def test_archives_round_trip(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, f"http://x/{i}", rng.choice(["<p>same</p>", "", None, "é" * 10, f"<b>{i}</b>", "WARC/1.1\r\n\r\n"])) for i in range(200)]
    rows += [(None, None, "<p>same</p>"), (None, "http://y\r\nX: 1", "null twice"), (None, None, "null twice"), (7, "u", "row"), (7, "u", "row"), (900, "long", "z" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    df.write.parquet(str(tmp_path / "p"))
    got = warc.archive(spark.read.parquet(str(tmp_path / "p")), f"file://{tmp_path}/w", rows_per_file=40).collect()
    groups = {}
    for i, _, h in rows:
        groups.setdefault(h or "", []).append(i)
    want = []
    for h, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        data = h.encode()
        sha = base64.b32encode(hashlib.sha1(data).digest()).decode()
        rest = list(ids)
        rest.remove(top)
        want += [(top, len(data), sha, "response", None)] + [(i, len(data), sha, "revisit", top) for i in rest]
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, want))
    # every archive is a sequence of members, and as a whole still a gzip file
    for path in (tmp_path / "w").glob("*.norm.warc.gz"):
        entries = list(warc.read_index(f"file://{path}".replace(".warc.gz", ".index")))
        assert entries[-1]["offset"] + entries[-1]["length"] == path.stat().st_size
        assert gzip.decompress(path.read_bytes()).count(b"WARC-Record-ID") == len(entries)
    empty = spark.createDataFrame([], df.schema)
    assert warc.archive(empty).count() == 0


def test_normaliser_takes_any_gzip_and_refuses_damage(tmp_path):
    one = warc.record(1, 1, "http://a", b"x" * 400_000, 400_000, warc.digest32(b"x" * 400_000), None)
    two = warc.record(2, 2, None, None, 400_000, warc.digest32(b"x" * 400_000), (1, 1))
    path = tmp_path / "m.warc.gz"
    path.write_bytes(gzip.compress(one) + gzip.compress(two + one))
    to, index, n = warc.normalise(f"file://{path}")
    assert n == 3
    entries = list(warc.read_index(index))
    with open(to.removeprefix("file://"), "rb") as f:
        heads = [warc.read_member(f, e) for e in reversed(entries)]
    assert [h["warc-type"] for h, _ in heads] == ["response", "revisit", "response"] and heads[0][1].endswith(b"x" * 400_000)
    path.write_bytes(gzip.compress(one[:-5000]))
    with pytest.raises(ValueError, match="ends within"):
        warc.normalise(f"file://{path}")


def test_least_size_keeps_small_copies_apart(spark):
    df = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb")], "page_id long, url string, html string").withColumn("n", F.monotonically_increasing_id())
    folder = warc.shared_dir(spark)
    made = warc.written(warc.write_archives(df, "n", folder, smallest=3))
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.read_archives(warc.written(warc.normalised(spark, made))).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}
