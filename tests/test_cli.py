import pytest

from strandloom import __main__ as cli
from strandloom.__main__ import main
from strandloom.plans.simulate import two_genomes
from strandloom.sources import fasta


def test_join_from_files(spark, tmp_path):
    """Two overlapping halves and reads over the gap between others are joined by files alone."""
    sc = two_genomes(4000, 60, 400, 0.0, (30, 30), seed=5)
    a, b = sc.genomes
    contigs = [a[:2200], a[2100:], b[:1900], b[2000:]]
    for name, seqs in (("c", contigs), ("r", sc.reads)):
        (tmp_path / f"{name}.fa").write_text("".join(f">{name}{i}\n{s}\n" for i, s in enumerate(seqs)))
    main(["join", f"file://{tmp_path}/c.fa", f"file://{tmp_path}/r.fa", f"file://{tmp_path}/out"])
    got = fasta.read(spark, f"file://{tmp_path}/out").collect()
    from strandloom.plans.simulate import COMPLEMENT

    assert all(any(r.seq in g or r.seq[::-1].translate(COMPLEMENT) in g for g in sc.genomes) for r in got)
    assert sorted(r.len for r in got) == [4000, 4000]


def test_fill_and_short(spark, tmp_path, monkeypatch):
    """Files, options and lists reach the plans, and what these return is written."""
    for name in ("c", "r", "sc", "sr"):
        (tmp_path / f"{name}.fa").write_text(f">{name} 1>2\nACGTACGTACGT\n")
    (tmp_path / "o.csv").write_text("c,noprev\n")
    path = lambda x: f"file://{tmp_path}/{x}"
    names = lambda *frames: [f.first().name for f in frames]
    seen = {}

    def fill(contigs, reads, ends, k):
        seen["fill"] = (names(contigs, reads), None if ends is None else ends.count(), k)
        return contigs

    def short(long_contigs, short_contigs, short_reads, long_reads, options, k):
        seen["short"] = (names(long_contigs, short_contigs, short_reads, long_reads), k)
        return short_contigs

    monkeypatch.setattr(cli, "fill_gaps", fill)
    monkeypatch.setattr(cli, "fix_with_short", short)
    main(["fill", path("c.fa"), path("r.fa"), path("filled"), "-ends", path("o.csv"), "-k", "14"])
    assert seen["fill"] == (["c", "r"], 1, 14) and fasta.read(spark, path("filled")).first().seq == "ACGTACGTACGT"
    main(["fill", path("c.fa"), path("r.fa"), path("filled")])
    assert seen["fill"] == (["c", "r"], None, 20)
    main(["short", path("c.fa"), path("r.fa"), path("merged"), "-contigs", path("sc.fa"), "-reads", path("sr.fa")])
    assert seen["short"] == (["c", "sc", "sr", "r"], 20) and fasta.read(spark, path("merged")).count() == 1
    with pytest.raises(SystemExit):
        main(["short", path("c.fa"), path("r.fa"), path("merged")])
