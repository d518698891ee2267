"""Merkle manifest, token files and periodic runs against plain versions that share none of their code."""

import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corymb.llm import idfiles, merkle, periodic, tokens

from .test_operators import DOCS, corpus, frame, nothing, words  # noqa: F401  (corpus is a fixture)

ODD = ["it's  we'll a,b c\n\n d", "x <|endoftext|> y<|endoftext|>z", "'s 't", " leading", "trailing ", "tab\tand  wide", "ÀÉ ñandú,que", "a\u0085b \u0085 c", "1,234 5.6!? (ok)", "日本語 テキスト", "é x", "​   a", "q" * 5000, "a" + " " * 300 + "b", "foo,'ll bar"]


def lots(n, seed=7):
    rng = random.Random(seed)
    letters = ["a", "b", "Q", "é", "ß", "ж", "日", " ", " ", "  ", "'", "'s", ",", ".", "\n", "\t", " ", " ", "<|endoftext|>", "1", "٣", "-", "\x1c", "\x7f", "🙂"]
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(n)]


# --- Merkle manifest -----------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    """Whole trees in lists, with paths by position."""

    def leaf(r, more=0):
        doc_id, text, lang, source, n = r
        values = [doc_id, source, lang, None if n is None else n + more, text]
        return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def tree(leaves):
        floors = [leaves]
        while len(floors[-1]) > 1:
            now = floors[-1]
            floors.append([sha(*now[i : i + 2]) for i in range(0, len(now), 2)])
        return floors

    def climb(h, floors, i):
        given = []
        for floor in floors[:-1]:
            pair = list(floor[i // 2 * 2 : i // 2 * 2 + 2])
            given += [x for k, x in enumerate(pair) if k != i % 2]
            pair[i % 2] = h
            h, i = sha(*pair), i // 2
        return h, given

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = tree([leaf(r) for r in groups[g]])
    crown = tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            sub, low = climb(leaf(r, int(touched)), trees[g], i)
            top, high = climb(sub, crown, k)
            out.append((r[0], leaf(r), trees[g][-1][0], crown[-1][0], sha(*low, *high), top, top == crown[-1][0]))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


def test_manifest_equals_plain_trees(spark, corpus):  # noqa: F811
    rows = [(i, t, lang, s, i % 11 if i % 3 else None) for i, t, lang, s, _ in corpus] + [(None, "x", "en", None, 5), (None, "x", "en", None, 5), (None, None, None, None, None)]
    got = merkle.proof_digest(frame(spark, rows), stride=2)  # several steps of the store on few rows
    assert ordered(got.collect()) == ordered(plain_manifest(rows))
    assert not got.where("NOT verified").isEmpty()


@pytest.mark.parametrize("n", [1, 2, 5, 8, 17])
def test_manifest_of_each_size(spark, n):
    rows = [(i, f"t{i}", "de" if i == 2 else "en", "s", i) for i in range(n)]
    assert ordered(merkle.proof_digest(frame(spark, rows, 2), stride=2).collect()) == ordered(plain_manifest(rows))


def test_many_groups_and_one_root(spark):
    rows = [(i, f"t{i}", f"g{i % 37}", "s", i) for i in range(80)]
    assert ordered(merkle.proof_digest(frame(spark, rows)).collect()) == ordered(plain_manifest(rows))


def test_manifest_of_nothing_and_of_clashing_names(spark):
    assert merkle.proof_digest(nothing(spark)).collect() == []
    rows = [(i, f"t{i}", "en", "s", i) for i in range(5)]
    more = frame(spark, rows).withColumn("hash", F.lit(1)).withColumn("pos", F.lit(2)).withColumn("group", F.lit("x"))
    assert ordered(merkle.proof_digest(more).collect()) == ordered(plain_manifest(rows))
    with pytest.raises(ValueError, match="no column"):
        merkle.proof_digest(more.drop("lang"))


def test_store_is_partitioned_by_level(spark, tmp_path):
    leaves = spark.range(3000).select(F.lit("en").alias("group"), F.col("id").alias("doc_id"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("hash"))
    made = merkle.Manifest(leaves, ("doc_id",), f"file://{tmp_path}/m")
    sizes = [made.trees.level(k).count() for k in range(13)]
    assert sizes == [3000, 1500, 750, 375, 188, 94, 47, 24, 12, 6, 3, 2, 1]
    assert sorted(p.name for p in (tmp_path / "m/groups/step=0").iterdir() if p.is_dir()) == sorted(f"level={k}" for k in range(11))
    paths = made.proofs("doc_id").collect()
    for r in paths[::97]:
        assert merkle.fold(bytes(r["hash"]), merkle.unpacked(bytes(r["path"]))) == bytes(r["root"])


# --- token files -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_pieces_encode_like_whole_texts(vocabulary):
    texts = ODD + lots(4000) + [None, "", "a", "ab"]
    whole = idfiles.encoder(vocabulary).tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    ids, begin = idfiles.encoder(vocabulary).encode(*tokens.text_bytes(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)] == [w.ids for w in whole]


def test_a_full_memory_of_pieces_starts_anew(vocabulary, monkeypatch):
    monkeypatch.setattr(idfiles, "CACHE", 50)
    own = idfiles.Encoder(vocabulary)
    for part in (lots(60, 1), lots(60, 2), lots(60, 1)):
        ids, begin = own.encode(*tokens.text_bytes(pa.array(part)))
        assert ids.tolist() == [i for w in own.tokenizer.encode_batch(part, add_special_tokens=False) for i in w.ids]


def plain_files(rows, vocabulary, end=2):
    from tokenizers import Tokenizer

    t, at, out = Tokenizer.from_file(vocabulary), 0, []
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, end]
        out.append((doc_id, at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        at += len(ids)
    return out


def test_token_files_equal_plain_encoding(spark, corpus, vocabulary):  # noqa: F811
    rows = list({r[0]: r for r in corpus}.values()) + [(-5 - i, t, None, None, None) for i, t in enumerate(ODD)]
    assert ordered(idfiles.id_digest(frame(spark, rows), vocabulary).collect()) == ordered(plain_files(rows, vocabulary))


def test_token_files_of_ties_nulls_nothing_and_clashes(spark, vocabulary):
    rows = [(3, "b c", None, None, 1), (3, "a", None, None, 1), (3, "a", None, None, 1), (None, "z z", None, None, 1), (None, None, None, None, 1), (1, "", None, None, 1)]
    got = sorted(map(tuple, idfiles.id_digest(frame(spark, rows).withColumn("th", F.lit(0)).withColumn("place", F.lit("x")), vocabulary).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None, 1, 3, 3, 3]
    assert [r[1] for r in got] == np.concatenate([[0], np.cumsum([r[2] for r in got])])[:-1].tolist()
    assert sorted(r[2:] for r in got) == sorted(r[2:] for r in plain_files(rows, vocabulary))
    assert idfiles.id_digest(nothing(spark), vocabulary).collect() == []
    with pytest.raises(ValueError, match="no column"):
        idfiles.id_digest(frame(spark, rows).drop("text"), vocabulary)


def test_shards_map_back_to_texts(spark, tmp_path, vocabulary):
    texts = [f"document {i} says {'again ' * (i % 7)}" for i in range(300)]
    folder = f"file://{tmp_path}/ids"
    manifest = idfiles.write_ids(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), folder, tokenizer=vocabulary, end_id=50256, shards=7)
    rows = sorted(manifest.collect(), key=lambda r: r["part"])
    assert [r["base"] for r in rows] == np.concatenate([[0], np.cumsum([r["n_ids"] for r in rows])])[:-1].tolist()
    decode, seen = idfiles.encoder(vocabulary).tokenizer.decode, []
    for r in rows:
        shard = idfiles.Shard(folder, r["file"], r["n_docs"], r["n_null"], r["kind"])
        assert isinstance(shard.map, np.memmap) and shard.map.dtype == np.uint16 and shard.offsets[-1] == r["n_ids"] == len(shard.map)
        seen += [(int(shard.doc_ids[i]), decode(shard.document(i)[:-1].tolist())) for i in range(r["n_docs"])]
        assert all(shard.document(i)[-1] == 50256 for i in range(r["n_docs"]))
    assert seen == list(enumerate(texts))


def test_many_small_shards_are_one_file_of_rows_and_few_tasks(spark, tmp_path, vocabulary):
    from corymb.llm.shared import shared_dir

    rows = [(i, f"text {i}", None, None, 1) for i in range(400)]
    files = lambda top: {str(p) for p in Path(top).rglob("part-*.parquet")}
    shared, folder = shared_dir(spark).removeprefix("file://"), f"file://{tmp_path}/ids"
    was = files(shared)
    manifest = idfiles.write_ids(frame(spark, rows), folder, tokenizer=vocabulary, end_id=2, shards=40)
    assert manifest.count() > 20 and len(files(tmp_path)) == 1 and files(shared) == was
    read = idfiles.read_ids(spark, folder)
    assert read.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism < 20
    assert ordered(read.collect()) == ordered(plain_files(rows, vocabulary))


# --- periodic runs -----------------------------------------------------------------------------------


def plain_runs(w, exponent=4, least=6):
    """By comparing each word with the one ``q`` further on, for every ``q``."""
    out, seen = [], set()
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and (i, j + q) not in seen and j + q - i >= max(least, exponent * q):
                seen.add((i, j + q))
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_digest(rows):
    out = []
    for doc_id, text, *_ in rows:
        w = (text or "").encode().split()
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        out.append((doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


def periodic_words(rng):
    w = []
    while len(w) < rng.randrange(1, 260):
        p = [rng.choice("abc") for _ in range(rng.randrange(1, 9))]
        w += (p * rng.randrange(1, 9))[: rng.randrange(1, 50)]
    return w


def test_runs_equal_comparing_every_period():
    rng = random.Random(3)
    texts = [[rng.choice("ab") for _ in range(rng.randrange(60))] for _ in range(300)] + [periodic_words(rng) for _ in range(200)] + [[], ["a"] * 5, ["a"] * 6, ["a"] * 97, list("ab") * 3, list("ab") * 4]
    ids = [periodic.numbered([x.encode() for x in w]) for w in texts]
    bounds = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
    for block in (1 << 18, 37):
        got = periodic.runs_of(np.concatenate(ids), bounds, block=block)
        assert got.tolist() == [[k, *r] for k, w in enumerate(texts) for r in plain_runs(w)]


def test_words_that_hash_alike_are_told_apart(monkeypatch):
    """Thue-Morse words collide under any power hash modulo 2**64, and a hash of nothing always does."""
    w = [0]
    while len(w) < 4096:
        w += [1 - x for x in w]
    ids = np.array(w + w[::-1] + [2] * 9, np.int64)
    want = [[0, *r] for r in plain_runs(ids.tolist())]
    assert periodic.runs_of(ids, np.array([0, len(ids)])).tolist() == want
    rng = random.Random(4)
    small = np.array([periodic.numbered(periodic_words(rng))][0])
    want = [[0, *r] for r in plain_runs(small.tolist())]
    monkeypatch.setattr(periodic, "mix", lambda x: x * np.uint64(0))
    assert periodic.runs_of(small, np.array([0, len(small)])).tolist() == want


def test_digest_equals_plain_digest(spark, corpus):  # noqa: F811
    rng = random.Random(9)
    rows = corpus + [(1000 + i, " ".join(periodic_words(rng)), None, None, None) for i in range(120)] + [(5000 + i, " ".join(words(rng, 90)), None, None, None) for i in range(150)] + [(None, "a " * 30, None, None, None)]
    assert ordered(periodic.run_digest(frame(spark, rows)).collect()) == ordered(plain_digest(rows))
    assert periodic.run_digest(nothing(spark)).collect() == []


def test_a_long_text_is_done_in_blocks():
    rng = random.Random(1)
    w = [rng.randrange(3000) for _ in range(60_000)]
    w[1000:9000] = (w[1000:1700] * 12)[:8000]
    w[30_000:30_900] = [7] * 900
    got = periodic.runs_of(np.array(w), np.array([0, len(w)]), block=1 << 12)
    assert [r[1:] for r in got.tolist() if r[2] > 500] == [[s, n, q] for s, n, q in [(1000, 8000, 700), (30_000, 900, 1)]]


def test_found_runs_keep_other_columns(spark):
    got = periodic.find_runs(spark.createDataFrame([(1, "x y " * 5, "old"), (2, None, "old")], "k int, text string, runs string")).collect()
    assert [(r["k"], [tuple(x) for x in r["runs"]]) for r in sorted(got)] == [(1, [(0, 10, 2)]), (2, [])]
