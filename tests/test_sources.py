from strandloom.operators.intervals import balanced_parts
from strandloom.sources import fasta, tables

FASTA = ">a first\nACGT\nAC\n\n>b\nGGGGGGGGGGGG\n>empty\n>c|x\nNNAC\n"


def test_fasta_round_trip(spark, tmp_path):
    (tmp_path / "in.fa").write_text(FASTA)
    rows = fasta.read(spark, f"file://{tmp_path}/in.fa", "set").orderBy("seq_idx")
    assert [tuple(r)[1:] for r in rows.collect()] == [(0, "a", "ACGTAC", 6), (1, "b", "G" * 12, 12), (2, "empty", "", 0), (3, "c|x", "NNAC", 4)]
    assert fasta.read(spark, f"file://{tmp_path}/in.fa", full_header=True).where("name = 'a first'").count() == 1
    fasta.write(rows, f"file://{tmp_path}/out", least=4)
    back = fasta.read(spark, f"file://{tmp_path}/out").orderBy("seq_idx")
    assert [(r.name, r.seq) for r in back.collect()] == [("Segkk0", "ACGTAC"), ("Segkk1", "G" * 12), ("Segkk2", "NNAC")]
    fasta.write(rows, f"file://{tmp_path}/wide", least=0, prefix=None, width=5)
    text = "".join(p.read_text() for p in (tmp_path / "wide").glob("*.txt"))
    assert ">b\nGGGGG\nGGGGG\nGG\n" in text
    assert fasta.cleaned(rows).where("name = 'cx'").count() == 1
    assert fasta.selected(rows, rows.where("name = 'b'")).count() == 1
    fasta.split(rows, f"file://{tmp_path}/parts", 2)
    assert len(list((tmp_path / "parts").glob("part=*"))) == 2


def test_many_files_keep_order(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"{i}.fa").write_text("".join(f">s{i}_{j}\nACGT\n" for j in range(20)))
    rows = fasta.read(spark, f"file://{tmp_path}/*.fa").orderBy("seq_idx").collect()
    assert [r.seq_idx for r in rows] == list(range(100))
    assert [r.name for r in rows] == [f"s{i}_{j}" for i in range(5) for j in range(20)]


def plain_fasta(text):
    out = []
    for line in text.replace("\r\n", "\n").split("\n"):
        if line.startswith(">"):
            out.append([line[1:].strip().split(" ")[0].split("\t")[0], ""])
        elif out:
            out[-1][1] += "".join(line.split())
    return [(n, s) for n, s in out]


def test_records_begin_at_lines_only(spark, tmp_path):
    """'>' within a header, line ends of two characters, text before the first record, over several partitions of a file."""
    parts = [f">read{i} 5'->3' end >x\r\n" + "ACGT\r\n" * (i % 7) + ("AC GT\r\n\r\n" if i % 3 else "") for i in range(400)]
    (tmp_path / "a.fa").write_bytes("".join(parts).encode())
    (tmp_path / "b.fa").write_bytes(b"; a comment\nACGT\n>first >>second\nAC\n>>odd\nGG\n>last")
    (tmp_path / "c.fa").write_bytes(b"")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        for name in "abc":
            rows = fasta.read(spark, f"file://{tmp_path}/{name}.fa").orderBy("seq_idx").collect()
            assert [(r.name, r.seq) for r in rows] == plain_fasta((tmp_path / f"{name}.fa").read_bytes().decode())
            assert [r.seq_idx for r in rows] == list(range(len(rows)))
        assert spark.read.text(f"file://{tmp_path}/a.fa").rdd.getNumPartitions() > 2
        both = fasta.read(spark, f"file://{tmp_path}/*.fa").orderBy("seq_idx").collect()
        assert [r.name for r in both] == [f"read{i}" for i in range(400)] + ["first", ">odd", "last"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_alignments(spark, tmp_path):
    text = "header\nsecond\n\n    [S1]     [E1]  |\n=====\n       1     1000  |     1000        1  |     1000     1000  |    99.50  | Contig1\tRead2\n"
    (tmp_path / "x.coords").write_text(text)
    aln = tables.read_alignments(spark, f"file://{tmp_path}/x.coords")
    want = (1, 1000, 1000, 1, 1000, 1000, 99.5, "Contig1", "Read2")
    assert [tuple(r) for r in aln.collect()] == [want]
    tables.write_alignments(aln, f"file://{tmp_path}/out")
    assert [tuple(r) for r in tables.read_alignments(spark, f"file://{tmp_path}/out").collect()] == [want]


def test_graph_text(spark, tmp_path):
    lines = ["3;5,3;4757;450-3887,123-5678;7-10;0", "7;7;;3-10;;1"]
    (tmp_path / "g.txt").write_text("\n".join(lines) + "\n")
    nodes, edges = tables.read_graph(spark, f"file://{tmp_path}/g.txt")
    assert {(r.id, tuple(r.members), tuple(r.overlaps), r.visited) for r in nodes.collect()} == {(3, (5, 3), (4757,), False), (7, (7,), (), True)}
    assert [(r.src, r.dst, r.wt) for r in edges.collect()] == [(3, 7, 10)]
    out = {r.value for r in tables.graph_lines(nodes, edges).collect()}
    assert out == {"3;5,3;4757;;7-10;0", "7;7;;3-10;;1"}


def test_lists(spark, tmp_path):
    (tmp_path / "c.csv").write_text("0,5,100\n1,-1,-1\n")
    assert [r.connector for r in tables.read_connections(spark, f"file://{tmp_path}/c.csv").orderBy("index").collect()] == [5, None]
    (tmp_path / "o.csv").write_text("Segkk0,noprev\nSegkk0,nonext\nSegkk1,nonext\n")
    assert sorted(map(tuple, tables.read_open_ends(spark, f"file://{tmp_path}/o.csv").collect())) == [("Segkk0", True, True), ("Segkk1", False, True)]
    (tmp_path / "b.csv").write_text("Contig12_p;Contig7_d;100;90\n")
    assert [tuple(r) for r in tables.read_blocked_edges(spark, f"file://{tmp_path}/b.csv").collect()] == [(24, 15, 100, 90)]
    (tmp_path / "m.json").write_text('{"a": 1.5, "b": 2}')
    assert sorted(map(tuple, tables.read_map(spark, f"file://{tmp_path}/m.json", "k", "v", "double").collect())) == [("a", 1.5), ("b", 2.0)]
    (tmp_path / "r.txt").write_text("# contigs (>= 0 bp)  7\n# misassemblies   3\n")
    assert [tuple(r)[1:] for r in tables.scrape_report(spark, f"file://{tmp_path}/r.txt").collect()] == [(3, 7)]
    tables.append_log(spark, f"file://{tmp_path}/log", {"x": 1})
    tables.append_log(spark, f"file://{tmp_path}/log", {"x": 2})
    assert spark.read.option("header", "true").csv(f"file://{tmp_path}/log").count() == 2


def test_balanced(spark):
    rows = spark.createDataFrame([(i, 10) for i in range(10)], "seq_idx long, len int")
    assert [r.part for r in balanced_parts(rows, 2).orderBy("seq_idx").collect()] == [0] * 5 + [1] * 5
