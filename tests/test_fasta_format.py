"""The FASTA data source against a plain parser, at all ranges of bytes."""

import gzip
import io

import pytest

from strandloom.sources import fasta_format as X

TEXTS = [
    ">a first 5'->3' end\nACGT\nAC\n\n>b\nGGGGGGGGGGGG\n>empty\n>c|x\tmore\nNN AC\n",
    "\nno record\n>a>b\r\nAC\r\nGT\r\n>c\r\n\r\nTT",
    ">one",
    "no > at the begin of a line\n",
    "",
    "".join(f">s{i} x>y\n" + "ACGT" * (i % 7) + "\n" for i in range(300)),
]


def plain(text):
    out, place = [], 0
    for line in text.split("\n"):
        if line.startswith(">"):
            out.append([place, line[1:].strip(), ""])
        elif out:
            out[-1][2] += "".join(line.split())
        place += len(line) + 1
    return [(p, (h.split() or [""])[0], h, s, len(s)) for p, h, s in out]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("step, block", [(1, 3), (7, 1), (7, 5), (64, 16), (10_000, 4)])
def test_ranges_give_each_record_once(text, step, block):
    data = text.encode()
    got = [x for a in range(0, len(data), step) for x in X.records(io.BytesIO(data), a, min(a + step, len(data)), block)]
    assert [p for p, _ in got] == [r[0] for r in plain(text)]
    assert ["".join(b.decode().split("\n", 1)[1:]).replace("\n", "").replace("\r", "").replace(" ", "") for _, b in got] == [r[3] for r in plain(text)]


def test_format(spark, tmp_path):
    X.register(spark)
    for i, text in enumerate(TEXTS):
        (tmp_path / f"{i}.fa").write_bytes(text.encode())
    (tmp_path / "_skipped").write_text(">no\nA\n")
    with gzip.open(tmp_path / "9.fa.gz", "wb") as f:
        f.write(TEXTS[0].encode())
    rows = spark.read.format("fasta").option("partitionBytes", 50).load(f"file://{tmp_path}")
    assert rows.rdd.getNumPartitions() > 50
    want = [(f"{tmp_path}/{n}", *r) for n, t in [*((f"{i}.fa", t) for i, t in enumerate(TEXTS)), ("9.fa.gz", TEXTS[0])] for r in plain(t)]
    assert sorted(map(tuple, rows.collect())) == sorted(want)
    # a schema of two columns, and filters on names that reach the reader
    short = spark.read.format("fasta").schema("len int, name string").load(f"{tmp_path}/[0-5].fa")
    assert {tuple(r) for r in short.where("name in ('b', 's8') and len > 0").collect()} == {(12, "b"), (4, "s8")}
    assert short.where("name like 's29%'").count() == 11
    idx = X.ordered(rows, "set", 50).orderBy("seq_idx").collect()
    assert [(r.seq_idx, r.name, r.seq) for r in idx] == [(k, w[2], w[4]) for k, w in enumerate(want)]


def test_written(spark, tmp_path):
    X.register(spark)
    path = f"file://{tmp_path}/out"
    rows = spark.createDataFrame([("a", "ACGTACGT"), ("b", ""), ("c", None), ("d", "T")], "name string, seq string").repartition(3)
    rows.write.format("fasta").mode("append").option("width", 3).save(path)
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.fa"))
    assert ">a\nACG\nTAC\nGT\n" in text and not list((tmp_path / "out").glob(".part*"))
    back = lambda: sorted((r.name, r.seq) for r in spark.read.format("fasta").load(path).collect())
    assert back() == [("a", "ACGTACGT"), ("b", ""), ("c", ""), ("d", "T")]
    rows.where("name = 'd'").write.format("fasta").mode("append").save(path)
    assert len(back()) == 5
    rows.where("name = 'a'").write.format("fasta").mode("overwrite").save(path)
    assert back() == [("a", "ACGTACGT")]
    with pytest.raises(Exception, match="broken"):
        bad = spark.range(3).selectExpr("if(id = 2, raise_error('broken'), cast(id as string)) name", "'A' seq")
        bad.write.format("fasta").mode("append").save(path)
    assert back() == [("a", "ACGTACGT")] and not list((tmp_path / "out").glob(".part*"))
    with pytest.raises(Exception, match="name and seq"):
        spark.range(1).write.format("fasta").mode("append").save(path)
