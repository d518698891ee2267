"""Zip archives: only wanted members are read."""

import zipfile

from corymb.sources import archives


def make(path, files, broken=()):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, raw in files.items():
            z.writestr(name, raw)
    for name in broken:  # a member whose bytes are spoilt can't be read
        with zipfile.ZipFile(path) as z:
            at = z.getinfo(name).header_offset
        raw = bytearray(path.read_bytes())
        raw[at + 30 + len(name) + 1] ^= 0xFF
        path.write_bytes(raw)


def rows(df):
    return sorted((r["archive"], r["member"], r["size"], bytes(r["content"])) for r in df.collect())


def test_members_are_read_without_unpacking(spark, tmp_path):
    make(tmp_path / "a.zip", {"x.csv": b"1,2\n", "deep/y.csv": b"3", "pic.png": b"\x89PNG", "empty.csv": b"", "folder/": b""})
    (tmp_path / "sub").mkdir()
    make(tmp_path / "sub" / "b.zip", {"x.csv": "é".encode() * 3000})
    (tmp_path / "other.txt").write_text("no")
    got = rows(archives.members(spark, f"file://{tmp_path}", ".csv"))
    assert got == [("a.zip", "deep/y.csv", 1, b"3"), ("a.zip", "empty.csv", 0, b""), ("a.zip", "x.csv", 4, b"1,2\n"), ("b.zip", "x.csv", 6000, "é".encode() * 3000)]
    assert [r[1] for r in rows(archives.members(spark, f"{tmp_path}/a.zip", ".png"))] == ["pic.png"]


def test_members_that_do_not_match_are_not_read(spark, tmp_path):
    make(tmp_path / "a.zip", {"good.csv": b"fine" * 50, "bad.csv": b"spoilt" * 50}, broken=["bad.csv"])
    d = archives.members(spark, f"file://{tmp_path}")
    for kept in ("member = 'good.csv'", "member LIKE 'good%'", "member LIKE '%od.csv'", "member IN ('good.csv', 'none')", "member LIKE '%ood%'"):
        assert [r[1] for r in rows(d.where(kept))] == ["good.csv"]
    assert d.where("member = 'none'").count() == 0


def test_large_archives_are_many_partitions(spark, tmp_path):
    make(tmp_path / "a.zip", {f"{i:02d}.bin": bytes(1000) for i in range(20)})
    d = archives.members(spark, f"file://{tmp_path}")
    assert d.rdd.getNumPartitions() == 1
    assert spark.read.format("zip_members").option("partitionBytes", 4000).load(f"file://{tmp_path}").rdd.getNumPartitions() == 5


def test_packed_archives_read_back(spark, tmp_path):
    from corymb.sources import tables

    rows_ = [("a", "1.txt", "one"), ("a", "2.txt", "two"), ("b", "1.txt", "")]
    tables.write_files(archives.packed(spark.createDataFrame(rows_, "s string, m string, c string"), "s", "m", "c"), f"file://{tmp_path}/out")
    assert rows(archives.members(spark, f"file://{tmp_path}/out")) == sorted((f"{s}.zip", m, len(c), c.encode()) for s, m, c in rows_)
    (tmp_path / "none").mkdir()
    assert archives.members(spark, f"file://{tmp_path}/none").count() == 0


def test_small_archives_share_a_task(spark, tmp_path):
    """Planning opens none of them, however many there are."""
    for i in range(30):
        with zipfile.ZipFile(tmp_path / f"{i:02d}.zip", "w") as z:
            z.writestr("a.csv", f"{i}")
            z.writestr("b.txt", "x")
    d = archives.members(spark, f"file://{tmp_path}", ".csv")
    assert d.rdd.getNumPartitions() == 1 and sorted((r["archive"], bytes(r["content"])) for r in d.collect()) == [(f"{i:02d}.zip", str(i).encode()) for i in range(30)]
