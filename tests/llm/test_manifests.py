"""Merkle manifest, token files and the prefix trie against plain Python over awkward rows."""

import math
import random
import zlib
from collections import Counter
from hashlib import md5, sha256

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barloom.llm import merkle, prefix_trie, queries, token_file
from barloom.llm.common import shared_folder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, block long, siblings string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes, fanout):
    """(top, siblings of each node) by rebuilding every level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for k, i in enumerate(at):
            run = range(i // fanout * fanout, min(i // fanout * fanout + fanout, len(level)))
            paths[k] += [level[j] for j in run if j != i]
            at[k] = i // fanout
        level = [h(*level[i:i + fanout]) for i in range(0, len(level), fanout)]
    return (level[0] if level else None), paths


def plain_manifest(rows, fanout):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"], h(*(framed(r[f]) for f in merkle.FIELDS))))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops, out = {}, []
    for g in order:
        leaves = sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        tops[g] = (leaves, *climb([x[1] for x in leaves], fanout))
    root, above = climb([tops[g][1] for g in order], fanout)
    for g, over in zip(order, above, strict=True):
        leaves, top, paths = tops[g]
        out += [(i, leaf, top, root, tuple(p + over)) for (i, leaf), p in zip(leaves, paths, strict=True)]
    return Counter(out)


def odd_documents(seed=3):
    rnd = random.Random(seed)
    langs = ["en", "de", "ä", None, "", "zz"]
    rows = [{"doc_id": rnd.randrange(400), "text": " ".join(rnd.choice(["Oak", "elm's", "ash", "été", "İş", "x1y22"]) for _ in range(rnd.randrange(30))),
             "lang": rnd.choice(langs[:5]) if rnd.random() < 0.6 else "en", "source": rnd.choice(["a", None, ""]), "n_chars": rnd.choice([None, 3, 12])} for _ in range(230)]
    rows += [dict(rows[0]) for _ in range(7)] + [{"doc_id": None, "text": t, "lang": "en", "source": "s", "n_chars": 1} for t in (None, "", "a", "a")]
    rows += [{"doc_id": 999, "text": "word " * 60_000, "lang": "zz", "source": None, "n_chars": None}, {"doc_id": 0, "text": "no newline\nat\x0ball  wide", "lang": None, "source": "a", "n_chars": 2}]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) + ("t", 1, "s") for r in rows], DOCS)


@pytest.mark.parametrize(("fanout", "levels"), [(2, 2), (3, 1), (2, 12)])
def test_manifest_equals_trees_built_level_by_level(spark, fanout, levels):
    rows = odd_documents()
    got = merkle.manifest(frame(spark, rows), claimed={"n_chars": F.when(F.col("doc_id") % 5 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}, fanout=fanout, levels=levels).collect()
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, tuple(r.siblings)) for r in got) == plain_manifest(rows, fanout)
    changed = {h(*(framed(r[f]) for f in merkle.FIELDS)) for r in rows if r["doc_id"] is not None and r["doc_id"] % 5 == 0 and r["n_chars"] is not None}
    assert changed and all(r.verified == (r.folded_root == r.root) == (r.leaf not in changed) for r in got)


def test_manifest_of_nothing_and_of_one(spark):
    assert merkle.manifest(frame(spark, [])).count() == 0
    row = merkle.manifest(frame(spark, [odd_documents()[0]])).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.siblings == [] and row.verified


@pytest.mark.parametrize("width", [1, 2, 5, 6, 7, 13, 27, 31])
def test_blocks_learn_root_and_proof_without_a_downward_pass(spark, width):
    nodes = [h(str(i)) for i in range(width)]
    for fanout in (2, 3, 4):
        state = spark.createDataFrame([("t", i, width, x, []) for i, x in enumerate(nodes)], "tree string, block long, width long, root string, siblings array<string>")
        got = {r.block: (r.root, r.siblings) for r in merkle.exchanged(state, fanout).collect()}
        top, paths = climb(nodes, fanout)
        assert got == {i: (top, p) for i, p in enumerate(paths)}


def plain_tokens(rows):
    model = Tokenizer.from_file(token_file.public_path(token_file.TOKENIZER))
    return {i: [*model.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}


def test_token_files_give_back_the_ids_of_whole_texts(spark):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents()]
    docs = frame(spark, odd_documents())
    folder = token_file.written(docs, shared_folder(spark), segment_ids=500, file_segments=3)
    read = token_file.read_back(spark, folder).collect()
    model = Tokenizer.from_file(token_file.public_path(token_file.TOKENIZER))
    want = Counter((i, tuple([*model.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in rows)
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in read) == want
    got = sorted(token_file.tokenized(docs, segment_ids=500, file_segments=3).collect(), key=lambda r: r.start)
    assert [r.doc_id is not None for r in got] == sorted(r.doc_id is not None for r in got)
    named = [r.doc_id for r in got if r.doc_id is not None]
    assert named == sorted(named) and got[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for (i, ids), k in want.items() for _ in range(k))
    assert token_file.tokenized(docs.limit(0)).count() == 0


def test_token_query_equals_the_library_on_whole_texts(spark):
    base = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{base}/documents.parquet").collect()}
    ids, start, want = plain_tokens(docs.items()), 0, {}
    for doc in sorted(docs):
        want[doc] = (start, len(ids[doc]), zlib.crc32(np.array(ids[doc], "<u4").tobytes()))
        start += len(ids[doc])
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op12_token_file(spark, base).collect()} == want


def test_the_encoders_memory_changes_nothing(monkeypatch):
    texts = [r["text"].encode() for r in odd_documents(8) if r["text"]]
    own = token_file.Encoder(token_file.public_path(token_file.TOKENIZER))
    want = own.encode(texts)
    monkeypatch.setattr(token_file, "MEMORY", 3)
    for a, b in zip(texts, np.split(want[0], np.cumsum(want[1])[:-1]), strict=True):
        assert own.encode([a])[0].tolist() == b.tolist()


@pytest.mark.parametrize("high", [1, 2, 300, 2**16, 2**31, 2**32])
def test_blocks_of_any_width_come_back_and_can_be_read_alone(high):
    rnd = np.random.default_rng(high)
    for n in (0, 1, 1023, 1024, 1025, 5000):
        ids = rnd.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
        ids[rnd.integers(0, max(n, 1), n // 90)] = high - 1
        cell = token_file.segment(3, 4, [(7, n), (None, 0)], ids)
        (part, number, docs, back), = token_file.segments(cell + token_file.SYNC.encode())
        assert (part, number, docs.tolist()) == (3, 4, [(7, 1, n), (0, 0, 0)]) and back.tolist() == ids.tolist()
    _, _, _, docs, n, rows, many, size = token_file.HEAD.unpack_from(cell)
    at = token_file.HEAD.size
    index, patches = np.frombuffer(cell, token_file.ENTRY, rows, at), np.frombuffer(cell, token_file.PATCH, many, at + rows * token_file.ENTRY.itemsize)
    alone = token_file.block_ids(index, patches, np.frombuffer(cell, np.uint8)[-size:] if size else np.zeros(0, np.uint8), 2, 4)
    assert alone.tolist() == ids[2048:4096].tolist()


def plain_trie(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            name = md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", name, len((text or "").encode().split())))
    said = {c: [t[3:] for t in sorted(own)] for c, own in convs.items()}
    built = {}
    for c in said:
        k = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(said.get(c - int(math.fmod(c, 20)), [])[:k] + said[c][k:])
    nodes = {}
    for c, own in built.items():
        for d in range(len(own) + 1):
            nodes.setdefault(tuple(t[0] for t in own[:d]), []).append(c)
    kids, words = Counter(p[:-1] for p in nodes if p), {tuple(t[0] for t in own[:d + 1]): own[d][1] for own in built.values() for d in range(len(own))}
    saved, leaves = Counter(), Counter()
    for p, own in nodes.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(own) - 1) * words.get(p, 0)
            leaves[p[:d]] += not kids[p]
    return Counter((min(own), len(p), min(nodes[p[:-1]]) if p else None, len(own), kids[p], leaves[p], saved[p],
                    h(",".join(str(c) for c in sorted(own) if len(built[c]) == len(p)))) for p, own in nodes.items())


@pytest.mark.parametrize(("convs", "turns"), [(4096, 1 << 18), (7, 1 << 18), (1, 1 << 18), (50, 9)])
def test_trie_equals_prefixes_counted_one_by_one(spark, convs, turns):
    rnd = random.Random(5)
    rows = [(c, rnd.choice([None, *range(9)]), rnd.choice(["user", "assistant", None]), rnd.choice(["hi", "ok go", None, "", "a b c"])) for c in range(0, 130) for _ in range(rnd.randrange(7))]
    rows += [(c, t, "user", f"same {t}") for c in range(200, 280) for t in range(3)]  # many that are the same throughout
    rows += [(c, t, "user", f"same {t}") for c in range(300, 330) for t in range(3 + c % 4)]
    rows += [(-7, 1, "user", "x"), (None, 1, "user", "no id"), (1001, 0, "user", "lone"), (500, 5, "user", "long")] + [(500, t, "user", "deep") for t in range(90)]
    rows += [rows[0], rows[0]]
    table = spark.createDataFrame([(*r, 1, "n", b"p") for r in rows], "conv_id long, turn long, role string, text string, depth int, name string, path binary")
    got = prefix_trie.rebuilt_trie(table.repartition(5), shard_conversations=convs, shard_turns=turns).collect()
    want = plain_trie([(c, t, r, x) for c, t, r, x in rows])
    assert Counter(map(tuple, got)) == want
    assert prefix_trie.rebuilt_trie(table.limit(0)).count() == 0
