"""Cross-tokenizer alignment, SimHash with BK-trees and spelling variants against brute force, on small tables with
nulls, empty and long texts, ties, repeated rows, no rows and clashing column names."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASH = ["id", "a", "b", "n_a", "place", "links", "node", "fingerprint", "component_id", "word", "n", "side"]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit(7) for c in CLASH})


# Operator 11

def byte_map():
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, more = {}, 256
    for b in range(256):
        out[chr(b) if b in own else chr(more)] = b
        more += b not in own
    return out


def aligned(rows):
    """{row number: (n_a, n_b, n_groups, n_links, n_best, count_sum, digest)}, two-pointer walk over the tokens."""
    import sentencepiece
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(A_PATH)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    byte = byte_map()
    entry = {i: bytes(byte[c] for c in w) for w, i in t.get_vocab().items()}
    piece = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    found, count = {}, collections.Counter()
    for k, (_, x) in enumerate(rows):
        a, b = (t.encode(" " + x, add_special_tokens=False).ids, sp.encode(x)) if x else ([], [])
        want = (" " + (x or "")).encode()
        if b"".join(entry[i] for i in a) != want or b"".join(piece(i) for i in b) != want:
            found[k] = (0, 0, 0, [], "")
            continue
        ea, eb = np.cumsum([len(entry[i]) for i in a]), np.cumsum([len(piece(i)) for i in b])
        links, groups, i, j, i0, j0 = [], [], 0, 0, 0, 0
        while i < len(a):
            links.append((a[i], b[j]))
            at, bt = ea[i], eb[j]
            i, j = i + (at <= bt), j + (bt <= at)
            if at == bt:
                groups.append(",".join(map(str, a[i0:i])) + "|" + ",".join(map(str, b[j0:j])))
                i0, j0 = i, j
        count.update(links)
        found[k] = (len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())
    top = collections.Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return [(na, nb, g, len(x), sum(count[p] == top[p[1]] for p in x), sum(count[p] for p in x), s) for na, nb, g, x, s in found.values()]


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(2)
    words = ["under", "standing", "naïve", "日本語", "🙂", "don't", "x1y2", "...", "\t", "\n\n", "  ", "é", "Ω", "un", "the"]
    rows = [(i, "".join(rng.choice(words + [" "] * 9, int(rng.integers(1, 80))))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " "), (103, "a▁b"), (104, "<|endoftext|> and </s> <s>"), (105, "\x00 \x7f \x85"),
             (106, "x" * 3000), (107, "word " * 30_000), (108, "same text"), (108, "same text"), (None, "no id"), (109, "é"), (110, "�​")]
    return rows


def test_alignment(spark, texts):
    from featureflow.llm.crosstok import align
    df = frame(spark, texts)
    want = sorted((str(i), *w) for (i, _), w in zip(texts, aligned(texts)))
    assert sum(w[1] == 0 for w in want) >= 3
    for frequent in (1 << 20, 40, 0):  # all pairs in the broadcast, some, none
        got = align(df, A_PATH, B_PATH, frequent=frequent)
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == want
    assert align(df.limit(0), A_PATH, B_PATH).count() == 0


def test_frequent_pairs_stay_within_their_bound(spark):
    from featureflow.llm.crosstok import frequent_pairs
    counts = spark.createDataFrame([(i, 1 + i % 50) for i in range(1000)], "pair long, n long")
    for limit in (0, 10, 100, 999, 1000):
        rows = frequent_pairs(counts, limit).collect()
        assert len(rows) <= limit
        assert not rows or min(r.n for r in rows) > max([0, *(r.n for r in counts.collect() if r.pair not in {x.pair for x in rows})])
    assert frequent_pairs(counts, 1000).count() == 1000


def test_byte_level_side_encodes_like_the_library():
    from tokenizers import Tokenizer

    from featureflow.llm.crosstok import byte_bpe
    data = open(A_PATH, encoding="utf-8").read()
    side, t = byte_bpe(data), Tokenizer.from_file(A_PATH)
    t.encode_special_tokens = True
    rng = np.random.default_rng(6)
    letters = list("aeiou thsnr'.0123-_\n\tÀéßæ中あ🙂  ") + ["ing", " the", "'ll", "aaaa", "<|endoftext|>"]
    some = ["".join(rng.choice(letters, int(rng.integers(1, 60)))) for _ in range(3000)]
    some += [f"a{chr(c)}1 {chr(c)}{chr(c)}" for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    assert side.encode(some) == [e.ids for e in t.encode_batch([" " + x for x in some], add_special_tokens=False)]
    with pytest.raises(ValueError):
        byte_bpe(data.replace('"add_prefix_space":false', '"add_prefix_space":true').replace('"add_prefix_space": false', '"add_prefix_space": true'))


# Operator 12

def simhash(text):
    import xxhash
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(w[k:k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked_classes(prints, radius=2):
    """{fingerprint: smallest member of its class}, all pairs."""
    keys = np.array(sorted(prints), np.uint64)
    root = {int(k): int(k) for k in keys}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for k in keys:
        for o in keys[np.bitwise_count(keys ^ k) <= radius]:
            a, b = top(int(k)), top(int(o))
            root[max(a, b)] = min(a, b)
    return {k: top(k) for k in root}


def test_simhash(spark):
    from featureflow.llm.simhash import near_duplicates
    rng = np.random.default_rng(31)
    vocabulary, rows = [f"w{i}" for i in range(400)], []
    for g in range(6):  # near copies
        base = list(rng.choice(vocabulary, 150))
        for _ in range(40):
            own = list(base)
            for at in rng.choice(150, rng.integers(0, 3), replace=False):
                own[at] = str(rng.choice(vocabulary))
            rows.append((len(rows), " ".join(own)))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "One two"), (504, "one  TWO"), (505, "É É é"), (506, "x " * 200_000), (None, ""),
             (None, "only without id"), (507, "a b c"), (507, "a b c"), (508, "Ä b")]
    prints = [simhash(t) for _, t in rows]
    roots = linked_classes(set(prints))
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[roots[p]] = min(i, least.get(roots[p], i))
    want = sorted((str(i), f"{p:016x}", str(least.get(roots[p]))) for (i, _), p in zip(rows, prints))
    df = frame(spark, rows)
    for capacity in (2048, 4):  # 4: shards are cut down to the last level
        got = near_duplicates(df, capacity=capacity)
        assert got.columns == ["doc_id", "fingerprint", "component_id"]
        assert sorted((str(r[0]), r[1], str(r[2])) for r in got.collect()) == want
    assert len(set(least.values())) < len(set(prints)) and near_duplicates(df.limit(0)).count() == 0


def test_bk_trees_find_all_pairs_and_follow_few_edges():
    from featureflow.llm.simhash import Trees
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 2**63, 1500).astype(np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (1500, 2)).astype(np.uint64)
    prints = np.unique(np.append(prints, [prints ^ flips[:, 0], prints ^ flips[:, 0] ^ flips[:, 1]]))
    group = rng.integers(0, 3, len(prints))
    tree = Trees(prints, group)
    got = {(int(x), int(y)) for a, b in tree.near() for x, y in zip(a, b)}
    far = np.bitwise_count(prints[:, None] ^ prints[None, :])
    i, j = np.nonzero((far <= 2) & (group[:, None] == group[None, :]) & (np.arange(len(prints))[:, None] < np.arange(len(prints))[None, :]))
    assert got == set(zip(i.tolist(), j.tolist())) and len(got) > 1000
    parent, distance = np.divmod(tree.keys, 65)  # a child's distance to its parent is its edge's key
    assert (np.bitwise_count(prints[parent] ^ prints[tree.children]) == distance).all() and len(tree.children) == len(prints) - 3


def test_shard_masks_share_a_part_for_every_two_flips():
    from featureflow.llm.simhash import masks
    rng = np.random.default_rng(3)
    for level in masks():
        assert all(0 < m < 1 << 64 for m in level)
    for _ in range(300):
        flips = sum({1 << int(b) for b in rng.integers(0, 64, 2)})
        kinds = [0]
        for level in masks():  # on every level some part of a shared kind is free of flips
            kinds = [k for parent in kinds for k in range(3 * parent, 3 * parent + 3) if not level[k] & flips]
            assert kinds
    assert max(64 - bin(m).count("1") for m in masks()[-1]) <= 14


# Operator 13

def variants(rows):
    n = collections.Counter()
    for i, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = r.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if h % 31 == 0:
                r = r[:h % len(r)] + r[h % len(r) + 1:]
            n[r] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    return variants_of(n)


def variants_of(n):
    same, near = collections.defaultdict(set), {w: set() for w in n}
    for w in n:
        for k in range(len(w)):
            same[k, w[:k] + w[k + 1:]].add(w)
    for (_, v), group in same.items():
        for w in group:
            near[w] |= group - {w}
            if v in n:
                near[w].add(v)
                near[v].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= 10 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=str)


def test_spelling(spark):
    from featureflow.llm.spelling import count_words, spelling_variants
    rng = np.random.default_rng(14)
    rows = []
    for i in range(300):
        words = ["".join(rng.choice(list("abé"), int(rng.integers(6, 10)))) for _ in range(30)]
        rows.append((i, " ".join(words) + " Necessary, NECESSARY necesary necessarÿ×÷ÿÿÿ"))
    long = "ab" * 1500
    rows += [(900, None), (901, ""), (902, "12 short"), (903, f"{long} {long} {long}b {long}b"), (904, "twelves twelves " * 20_000),
             (905, "repeated repeated"), (905, "repeated repeated"), (None, "nothing nothing nothings"), (906, "aaaaaaa aaaaaaa aaaaaaaa aaaaaaaa")]
    df = frame(spark, rows)
    got = spelling_variants(count_words(df))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = variants(rows)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert sum(w[1] is not None for w in want) > 3 and any(w[4] > 5 for w in want)
    assert spelling_variants(count_words(df.limit(0))).count() == 0


def test_spelling_chains_ties_and_edits_at_the_ends(spark):
    from featureflow.llm.spelling import spelling_variants
    n = {"abcdefg": 2, "abcdefgh": 30, "abcdefghi": 500, "abcdefghij": 9000, "xbcdefg": 2, "bcdefgh": 25, "zzzzzzz": 4,
         "qrstuvw": 2, "qrstuvx": 20, "qrstuva": 20, "qqrstuvw": 20, "aaaaaaa": 3, "aaaaaaaa": 40, "aaabaaaa": 40, "ÿbcdefg": 7}
    n |= {"k" * 4000: 5, "k" * 3999: 60, "k" * 2000 + "m" + "k" * 1999: 5}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    got = sorted(map(tuple, spelling_variants(words).collect()), key=str)
    assert got == variants_of(n)
    assert {g[0]: g[2] for g in got}["abcdefg"] == "abcdefghij"  # form after form


def test_a_trie_node_shared_by_other_words_adds_nothing(spark, monkeypatch):
    """All prefixes of one length as one node: more ways are walked, the words themselves decide."""
    from featureflow.llm import spelling
    rng = np.random.default_rng(5)
    n = {"".join(rng.choice(list("abc"), int(rng.integers(7, 10)))): int(c) for c in rng.integers(2, 90, 150)}
    monkeypatch.setattr(spelling, "BYTE_CODE", np.zeros(256, np.uint64))
    # workers take the functions from the driver's module by reference, so run the path step here
    import pyarrow as pa
    words = sorted(n)
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(words), np.int32)), pa.array(words)], ["side", "word"])
    out = pa.Table.from_batches(list(spelling._paths(iter([batch])))).to_pydict()
    assert len({(a, x) for a, x in zip(out["at"], out["node"])}) == len(set(out["at"]))
    for w, at, step in zip(out["word"], out["at"], out["step"]):
        assert step == w[at:at + 1]
