"""Text operators against brute force on small tables with nulls, empty texts, repeated rows and clashing columns."""

import collections
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from tidelens.llm import line_dedup, mixing, packing, simhash_dedup, suffix_dedup, token_files
from tidelens.llm._shared import scratch
from tidelens.llm._tokens import Encoder

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, mix string, score string, gone int, key int, n int, of string"


def rng(seed=0):
    return np.random.default_rng(seed)


def words(r, n):
    return " ".join("".join(r.choice(list("abcdefg"), r.integers(2, 6))) for _ in range(n))


def table(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", f"s{i % 3}" if i % 5 else None, None if t is None else len(t), 1, "x", "y", 2, 3, 4, "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


EDGES = [None, "", " \n\t", "a", "A b", "a b c", "A  B\tc", "Ünï cödé ok", "a b c", "x " * 5000]


def encode(name, text):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_remembered_pieces_give_the_librarys_ids(name):
    texts = [t or "" for t in EDGES] + [
        " a", "a ", "a  b", "a \nb", "a\n b", "a\n\nb", "\na", "a\n", "It's, he'll. x.y ...,.", "x?, y., z", "ﬁ ½ x² ª", "<|endoftext|> a", "日本語 text", "ÀÉ ß ÿ, é.",
        "1,000.5 a1b2", "foo' bar 's 't", "a.\nB,", "I'm 'S", "A b", "Foo.", "a. b\nC, D.\nE f", "x\ny\n", words(rng(), 500).replace(" ", ", "),
    ]
    e = Encoder(public_tokenizers.path(name))
    for _ in range(2):
        assert list(e.encode(texts)) == [np.array(encode(name, t), "<u4").tobytes() for t in texts]


def test_a_small_memory_gives_the_same_ids(monkeypatch):
    from tidelens.llm import _tokens

    monkeypatch.setattr(_tokens, "REMEMBERED", 10)
    monkeypatch.setattr(_tokens, "TEXT", 100)
    monkeypatch.setattr(_tokens, "LONGEST", 4)
    texts = [words(rng(i), 40) for i in range(20)]
    e = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert list(e.encode(texts)) == [np.array(encode("word_bpe_49k.json", t), "<u4").tobytes() for t in texts]


def test_packing_covers_every_id_once_with_little_padding(spark):
    r = rng(1)
    texts = EDGES + [words(r, int(r.integers(1, 900))) for _ in range(60)]
    got = packing.pack(table(spark, texts).repartition(2), public_tokenizers.path("byte_bpe_50k.json")).collect()
    docs, windows = collections.defaultdict(list), collections.defaultdict(list)
    for x in got:
        docs[x["doc_id"]].append(x)
        windows[x["sequence_id"]].append(x)
    assert sorted(docs) == list(range(len(texts)))
    for i, t in enumerate(texts):
        at = 0
        ids = np.array([*encode("byte_bpe_50k.json", t), 0], "<u4")
        for x in sorted(docs[i], key=lambda x: x["start"]):
            part = ids[at : at + x["length"]].tobytes()
            assert (x["start"], x["ids"], x["ids_crc32"], x["doc_tokens"]) == (at, part, zlib.crc32(part), len(ids))
            at += x["length"]
        assert at == len(ids)
    fills = []
    for w in windows.values():
        at = 0
        for x in sorted(w, key=lambda x: x["offset"]):
            assert x["offset"] == at and x["length"] > 0
            at += x["length"]
        fills.append(at)
    assert max(fills) <= 1024 and sum(f < 1024 for f in fills) <= 2  # one a partition
    assert packing.pack(table(spark, texts).limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_documents_without_or_with_one_id_are_packed_apart(spark):
    texts = ["a b c", "a b c", "d", None, "e " * 3000]
    docs = table(spark, texts, [None, 1, 1, None, 2]).selectExpr("*", "7 AS sequence_id", "'x' AS ids")
    got = packing.pack(docs.coalesce(1), public_tokenizers.path("byte_bpe_50k.json")).collect()
    sizes = collections.Counter((i, len(encode("byte_bpe_50k.json", t)) + 1) for i, t in zip([None, 1, 1, None, 2], texts, strict=True))
    tokens = collections.Counter()
    for x in got:
        tokens[x["doc_id"], x["doc_tokens"]] += x["length"]
    assert tokens == {k: k[1] * n for k, n in sizes.items()} and len({(x["sequence_id"], x["offset"]) for x in got}) == len(got)


def test_a_worker_forgets_other_work(monkeypatch):
    from tidelens.llm import _shared

    gone = []
    monkeypatch.setattr(_shared, "_remembered", {"a": lambda: gone.append("a"), "b": lambda: gone.append("b")})
    monkeypatch.setattr(_shared, "_last", [""])
    for work in ("a", "a", "b", "c", "c"):
        _shared.begin(work)
    assert gone == ["b", "a", "a", "b"]


def test_the_level_minimises_the_sum_of_squares():
    p, r = packing.Packer(64), rng(2)
    for i in range(400):
        size = int(r.integers(1, 64))

        def cost(h, size=size):
            c = p.count.copy()
            c[h] -= h > 0
            c[h + size] += h + size < 64
            return int((c[1:64] ** 2).sum())

        fits = [h for h in range(64 - size + 1) if h == 0 or p.count[h]]
        assert cost(p.level(size)) == min(map(cost, fits))
        list(p.add(i, bytes(4 * size)))


def test_token_files_round_trip(spark):
    texts = EDGES + [words(rng(i), 30) for i in range(150)]
    ids = [None if i == 3 else i * 7 % 101 for i in range(len(texts))]  # repeated ones and a null
    folder = scratch(spark, "test")
    token_files.write_tokens(table(spark, texts, ids), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    got = token_files.read_tokens(spark, folder).orderBy("start").collect()
    assert [x["doc_id"] for x in got] == [None, *sorted(i for i in ids if i is not None)]
    at = 0
    for x in got:
        assert (x["start"], x["n_tokens"], len(x["ids"])) == (at, len(x["ids"]) // 4, 4 * x["n_tokens"])
        at += x["n_tokens"]
    want = collections.Counter((i, np.array([*encode("word_bpe_49k.json", t), 1], "<u4").tobytes()) for i, t in zip(ids, texts, strict=True))
    assert want == collections.Counter((x["doc_id"], bytes(x["ids"])) for x in got)
    assert sorted(x.tobytes() for x in token_files.read_document(folder, 7)) == sorted(b for (i, b), n in want.items() if i == 7 for _ in range(n))
    rolled = scratch(spark, "test")
    token_files.write_tokens(table(spark, texts, ids).coalesce(1), rolled, public_tokenizers.path("word_bpe_49k.json"), end_id=1, file_bytes=300)
    again = token_files.read_tokens(spark, rolled).orderBy("start").collect()
    assert again == got and len(token_files.FileSystem.from_uri(rolled)[0].get_file_info(token_files.pa.fs.FileSelector(token_files.FileSystem.from_uri(rolled)[1]))) > 10
    assert [x.tobytes() for x in token_files.read_document(rolled, 7)] == [x.tobytes() for x in token_files.read_document(folder, 7)]
    empty = scratch(spark, "test")
    token_files.write_tokens(table(spark, texts).limit(0), empty, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    assert token_files.read_tokens(spark, empty).count() == 0


def test_long_words_and_texts_have_the_librarys_ids(spark):
    texts = ["x" * 1_000_001, words(rng(14), 2000) * 100, "é" * 300_000]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        assert list(Encoder(public_tokenizers.path(name)).encode(texts)) == [np.array(encode(name, t), "<u4").tobytes() for t in texts]


def test_a_small_sample_has_a_dictionary(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    few = token_files.train_dictionary(table(spark, ["one two", "one three"] * 3), path, 1, 2)
    many = token_files.train_dictionary(table(spark, [words(rng(i), 300) for i in range(100)]), path, 1, 2)
    assert 0 < len(few) < 100 and 1000 < len(many) <= token_files.DICTIONARY
    assert token_files.train_dictionary(table(spark, []), path, 1, 2) == b""


def lines_to_remove(docs):
    rows = []
    for d, t in docs:
        for n, w in enumerate(line_dedup.normal_lines(t)):
            if len(w) >= line_dedup.WORDS:
                h = [int.from_bytes(xxhash.xxh64_digest(y), "big") for y in w]
                rows.append((d, n, b" ".join(w).decode(), sum((2 * sum(x >> i & 1 for x in h) > len(h)) << i for i in range(64))))
    group = list(range(len(rows)))
    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            if a[2] == b[2] or ((a[3] ^ b[3]).bit_count() <= 3 and line_dedup.similar(a[2], b[2])):
                x, y = sorted((group[i], group[j]))
                group = [x if g == y else g for g in group]
    gone, seen = collections.defaultdict(set), set()
    for g, (d, n, _, _) in sorted(zip(group, rows, strict=True), key=lambda x: x[1][:2]):
        if g in seen:
            gone[d].add(n)
        seen.add(g)
    return gone


@pytest.mark.parametrize("limit", [1024, 4])
def test_fuzzy_lines(spark, monkeypatch, limit):
    monkeypatch.setattr(line_dedup, "GROUP", limit)
    monkeypatch.setattr(line_dedup, "NARROW", limit)
    monkeypatch.setattr(simhash_dedup, "SMALL", 8 if limit > 4 else 2)
    r = rng(3)
    vocabulary = ["".join(r.choice(list("abcdefghij"), r.integers(2, 8))) for _ in range(300)]
    base = [list(r.choice(vocabulary, r.integers(3, 30))) for _ in range(30)]
    texts = list(EDGES)
    for _ in range(80):
        some = []
        for _ in range(int(r.integers(0, 5))):
            line = list(base[int(r.integers(30))])
            for _ in range(int(r.integers(0, 3))):
                line[int(r.integers(len(line)))] = str(r.choice(vocabulary))
            some.append(" ".join(line).capitalize() + str(r.choice(["", ".", "!"])))
        texts.append("\n".join(some))
    docs = table(spark, texts)
    gone = lines_to_remove(list(enumerate(texts)))
    out = {x["doc_id"]: x for x in line_dedup.drop_repeated_lines(docs).collect()}
    for i, t in enumerate(texts):
        want = t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i])
        assert out[i]["text"] == want and out[i]["n_chars"] == (None if want is None else len(want)) and out[i]["gone"] == 2
    assert sum(map(len, gone.values())) > 30
    assert line_dedup.drop_repeated_lines(docs.limit(0)).columns == docs.columns


def test_edit_distance():
    r = rng(4)
    for _ in range(300):
        a, b = ("".join(r.choice(list("abc"), r.integers(0, 12))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            new = [i]
            for j, e in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
            row = new
        assert line_dedup.edit_distance(a, b) == row[-1]


@pytest.mark.parametrize("few", [0, 1000])
def test_many_distances_at_a_time(monkeypatch, few):
    monkeypatch.setattr(line_dedup, "FEW", few)
    r = rng(12)
    pairs = []
    for n in (0, 1, 5, 60, 64, 65, 130, 300):
        for _ in range(40):
            a = "".join(r.choice(list("abcdé 日"), n))
            b = list(a)
            for _ in range(int(r.integers(0, max(2, n // 3)))):
                k = int(r.integers(0, len(b) + 1))
                b[k : k + int(r.integers(0, 2))] = str(r.choice(["", "x", "b", "zz"]))
            pairs.append((a, "".join(b)) if r.random() < 0.5 else ("".join(b), a))
    far = np.array([line_dedup.edit_distance(a, b) for a, b in pairs])
    for shift in (-1, 0, 1):
        assert (line_dedup.near_enough(pairs, far + shift) == (shift >= 0)).all()
    counts = line_dedup._counts([x for p in pairs for x in p])
    u = np.arange(0, 2 * len(pairs), 2)
    assert not line_dedup._far(counts, u, u + 1, far).any() and line_dedup._far(counts, u, np.roll(u, 40), far).any()
    assert line_dedup.near_enough([], np.zeros(0, int)).shape == (0,)


def test_insertions_as_long_as_the_limit_are_near():
    r = rng(15)
    for n in (100, 130, 400):
        pairs = []
        for _ in range(40):
            a, k = "".join(r.choice(list("abcd "), n)), int(r.integers(0, n))
            pairs.append((a, a[:k] + "".join(r.choice(list("abcd "), n // 5)) + a[k:]))
        far = np.array([line_dedup.edit_distance(a, b) for a, b in pairs])
        assert (far == n // 5).all()
        assert line_dedup.near_enough(pairs, far).all() and not line_dedup.near_enough(pairs, far - 1).any()


def syllables(r, n):
    return "".join(r.choice(["th", "er ", "an", "on ", "ing", "ed ", "le", "re", "at", "é", "日 "], n))


def test_misplaced_pairs_are_far_apart():
    r, pairs = rng(16), []
    for _ in range(600):
        a = syllables(r, int(r.integers(1, 300)))
        b, many, k = list(a), int(r.integers(1, 2 + len(a) // 5)), int(r.integers(0, len(a)))
        kind = r.integers(0, 3)
        if kind == 0:
            b[k:k] = syllables(r, many)[:many]
        elif kind == 1:
            del b[k : k + many]
        else:
            for k in r.integers(0, len(a), many):
                b[k : k + int(r.integers(0, 2))] = str(r.choice(["", "x", "ü"]))
        pairs.append((a, "".join(b) or "x"))
    far = np.array([line_dedup.edit_distance(a, b) for a, b in pairs])
    places = line_dedup._Places([x for p in pairs for x in p])
    u = np.arange(0, 1200, 2)
    assert not line_dedup._misplaced(places, u, u + 1, far).any() and not line_dedup._misplaced(places, u + 1, u, far).any()
    assert line_dedup._misplaced(places, u, u, np.full(600, -1)).all()


def test_few_distances_of_unlike_lines_are_taken(monkeypatch):
    import pyarrow as pa

    r, calls, near = rng(17), [], line_dedup.near_enough
    monkeypatch.setattr(line_dedup, "near_enough", lambda pairs, most: calls.append(len(pairs)) or near(pairs, most))
    texts = [syllables(r, 120)[:250] for _ in range(120)]
    texts += [x[:100] + "zz" + x[104:] for x in texts[:20]]
    one = pa.array([0] * len(texts), pa.int64())
    batch = pa.RecordBatch.from_arrays([one, one, one, one, pa.array(range(len(texts)), pa.int64()), pa.array([x.encode() for x in texts], pa.binary())], ["near", "key", "a", "b", "node", "text"])
    links = {tuple(sorted(x)) for b in line_dedup._spanned(0.8)(iter([batch])) for x in zip(*[c.to_pylist() for c in b.columns], strict=True)}
    assert links == {(i, 120 + i) for i in range(20)}
    assert sum(calls) < 200  # of 9,730 pairs


@pytest.mark.parametrize("room", [40, 1 << 21])
def test_packed_keys_give_the_same_sets(monkeypatch, room):
    import pyarrow as pa

    monkeypatch.setattr(line_dedup, "UNPACKED", room)
    r = rng(18)
    keys = r.integers(-(2**63), 2**63 - 1, 600)
    keys = np.r_[keys[r.integers(0, 600, 4000)], np.repeat(keys[:2], (300, 100))]
    nodes = r.integers(-150, 150, len(keys))
    order = np.argsort(keys)

    def rows(batches):
        return {x for b in batches for x in zip(*[c.to_pylist() for c in b.columns], strict=True)}

    want = rows(line_dedup._sets(12)(iter([pa.RecordBatch.from_arrays([pa.array(keys[order]), pa.array(nodes[order])], ["key", "node"])])))
    packed = pa.Table.from_batches([line_dedup._packed(keys[i::9], nodes[i::9], 5) for i in range(9)]).sort_by("bucket")
    assert packed.num_rows <= 9 * 32 and {x[0] for x in want} == {0, 1}
    assert rows(line_dedup._unpacked(12)(iter(packed.to_batches(max_chunksize=7)))) == want


def test_pairs_of_many_groups_are_decided_together(monkeypatch):
    import pyarrow as pa

    r, calls = rng(14), []
    near = line_dedup.near_enough
    monkeypatch.setattr(line_dedup, "near_enough", lambda pairs, most: calls.append(len(pairs)) or near(pairs, most))
    rows = []
    for g in range(2000):
        a = list("".join(r.choice(list("abcdefgh "), 60)))
        b = list(a)
        for k in range(0, 60, 5 if g % 2 else 3):  # more are changed than are forgiven in every other pair
            b[k] = "x"
        rows += [(g, g, 0, 0, 2 * g + i, "".join(x).encode()) for i, x in enumerate((a, b))]
    columns = list(zip(*rows, strict=True))
    batch = pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:5]], pa.array(columns[5], pa.binary())], ["near", "key", "a", "b", "node", "text"])
    links = {(u, v) for b in line_dedup._spanned(0.8)(iter([batch])) for u, v in zip(*[c.to_pylist() for c in b.columns], strict=True)}
    assert {tuple(sorted(x)) for x in links} == {(2 * g, 2 * g + 1) for g in range(2000) if line_dedup.similar(rows[2 * g][5].decode(), rows[2 * g + 1][5].decode())}
    assert 900 < len(links) < 1100 and len([n for n in calls if n]) == 1


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_sets_of_keys_are_the_same_whatever_the_batches(size):
    import pyarrow as pa

    r = rng(13)
    rows = sorted((int(k), int(v)) for k, v in zip(r.integers(-20, 20, 400), r.integers(-9, 9, 400), strict=True))
    rows += [(99, v) for v in range(30)]
    parts = [rows[i : i + size] for i in range(0, len(rows), size)]
    got = collections.defaultdict(set)
    for b in line_dedup._sets(12)(pa.RecordBatch.from_arrays([pa.array([x[i] for x in p], pa.int64()) for i in (0, 1)], ["key", "node"]) for p in parts):
        for kind, _, key, node in zip(*[c.to_pylist() for c in b.columns], strict=True):
            got[kind, key].add(node)
    want = collections.defaultdict(set)
    for k, v in rows:
        want[k].add(v)
    assert {frozenset(v) for (kind, _), v in got.items() if kind == 0} == {frozenset(v) for v in want.values() if 1 < len(v) <= 12}
    assert {k: v for (kind, k), v in got.items() if kind == 1} == {k: v for k, v in want.items() if len(v) > 12}
    assert len([1 for kind, _ in got if kind == 0]) == len({frozenset(v) for v in want.values() if 1 < len(v) <= 12})


def spans(texts, length, keep):
    seen = collections.defaultdict(list)
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            seen[t[p : p + length]].append((i, p))
    out = []
    for i, t in enumerate(texts):
        cover = np.zeros(len(t) + 1, int)
        for p in range(len(t) - length + 1):
            at = seen[t[p : p + length]]
            if len(at) > 1 and (keep == "none" or at[0] != (i, p)):
                cover[p : p + length] = 1
        edge = np.diff(np.r_[0, cover])
        out.append(list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)))
    return out


@pytest.mark.parametrize("limit,keep", [(128, "none"), (2, "none"), (2, "first")])
def test_repeated_substrings(spark, monkeypatch, limit, keep):
    monkeypatch.setattr(suffix_dedup, "GROUP", limit)
    r = rng(5)
    common, texts = words(r, 30), list(EDGES)
    for i in range(120):
        t = words(r, int(r.integers(0, 60)))
        if i % 3 == 0:
            k = int(r.integers(0, 40))
            t += " " + common[k : k + int(r.integers(20, 120))] + " " + words(r, int(r.integers(0, 30)))
        t += ("ab" * int(r.integers(1, 200)) if i % 7 == 0 else "") + ("x" * int(r.integers(1, 200)) if i % 11 == 0 else "")
        if i % 13 == 0:
            t = texts[-1] or ""
        if i % 17 == 0:
            u = texts[-2] or ""
            t = u[: len(u) // 2] + "Q" + u[len(u) // 2 :]
        texts.append(t)
    raw = [(t or "").encode() for t in texts]
    got = {x["doc_id"]: x for x in suffix_dedup.repeats(table(spark, texts), 40, keep).collect()}
    for i, (t, want) in enumerate(zip(raw, spans(raw, 40, keep), strict=True)):
        assert [(s["a"], s["b"]) for s in got[i]["spans"] or []] == want
        assert (got[i]["n_bytes"], bytes(got[i]["kept"])) == (len(t), b"".join(t[a:b] for a, b in zip([0, *[s[1] for s in want]], [*[s[0] for s in want], len(t)], strict=True)))


def test_rows_that_repeat_a_document_are_copies(spark):
    t = words(rng(6), 40)
    got = suffix_dedup.repeats(table(spark, [t, t, "short", None], [1, 1, None, None]), 40).collect()
    assert sorted((x["doc_id"] or 0, len(x["kept"])) for x in got) == [(0, 0), (0, 5), (1, 0), (1, 0)]


def simhash(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum((2 * sum(x >> i & 1 for x in h) > len(h)) << i for i in range(64)) if h else 0


@pytest.mark.parametrize("limit", [4096, 3])
def test_simhash_links_all_within_three_bits(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash_dedup, "GROUP", limit)
    monkeypatch.setattr(simhash_dedup, "SMALL", 64 if limit > 3 else 2)
    r = rng(7)
    base = [words(r, 60).split() for _ in range(12)]
    texts = list(EDGES)
    for _ in range(150):
        w = list(base[int(r.integers(12))])
        for _ in range(int(r.integers(0, 3))):
            w[int(r.integers(60))] = "zz"
        texts.append(" ".join(w))
    bits = [simhash(t) for t in texts]
    part = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (bits[i] ^ bits[j]).bit_count() <= 3:
                x, y = sorted((part[i], part[j]))
                part = [x if p == y else p for p in part]
    got = {x["doc_id"]: (x["bits"] % 2**64, x["component_id"]) for x in simhash_dedup.near_duplicates(table(spark, texts)).collect()}
    assert got == {i: (bits[i], part[i]) for i in range(len(texts))}
    assert len(set(part)) < len(texts) - 20
    if limit == 4096:
        kept = simhash_dedup.keep_one(table(spark, texts))
        assert sorted(x["doc_id"] for x in kept.collect()) == sorted(set(part)) and kept.columns == table(spark, []).columns
        twice = simhash_dedup.near_duplicates(table(spark, ["a b", "a b", "q r"], [4, 4, None]))
        assert sorted((x["doc_id"] or -1, x["component_id"] or -1) for x in twice.collect()) == [(-1, -1), (4, 4), (4, 4)]


def test_mix_meets_its_targets(spark):
    r = rng(8)
    texts = EDGES + [words(r, int(r.integers(1, 60))) for _ in range(400)]
    docs = table(spark, texts)
    got = mixing.mix(docs).collect()
    again = {x["doc_id"]: x["mix"]["copies"] for x in mixing.mix(docs.repartition(3)).collect()}
    assert again == {x["doc_id"]: x["mix"]["copies"] for x in got} and len(got) == len(texts)
    by = collections.defaultdict(list)
    for x in got:
        size = len((x["text"] or "").encode().split())
        assert x["mix"]["size"] == size and 0 <= x["mix"]["copies"] <= 3 and x["size"] == 1
        by[x["source"]].append((size, x["mix"]["copies"] * size, x["mix"]["target"]))
    total = sum(s for v in by.values() for s, _, _ in v)
    assert abs(sum(v[0][2] for v in by.values()) - total) < 1e-6 * total
    for v in by.values():
        own, taken, target = sum(s for s, _, _ in v), sum(t for _, t, _ in v), v[0][2]
        assert target <= 3 * own + 1e-6 and abs(taken - target) <= max(s for s, _, _ in v)
    rows = collections.Counter(x["doc_id"] for x in mixing.mixed_rows(docs).collect())
    assert rows == {x["doc_id"]: x["mix"]["copies"] for x in got if x["mix"]["copies"]}
    assert mixing.mix(docs.limit(0)).count() == 0


def test_a_mix_without_ids_comes_near_its_targets(spark):
    r = rng(18)
    texts = [words(r, int(r.integers(1, 60))) for _ in range(400)]
    docs = table(spark, texts, [None] * 400)
    got = mixing.mix(docs).collect()
    by = collections.defaultdict(list)
    for x in got:
        by[x["source"]].append((x["mix"]["size"], x["mix"]["copies"] * x["mix"]["size"], x["mix"]["target"]))
    assert len(got) == 400 and all(abs(sum(t for _, t, _ in v) - v[0][2]) <= max(s for s, _, _ in v) for v in by.values())


def test_mix_reshares_what_is_above_the_cap(spark):
    docs = spark.createDataFrame([(1, "a " * 10, "a"), (2, "b " * 100, "b"), (3, "c " * 100, "c")], "doc_id bigint, text string, source string")
    assert {x["source"]: round(x["target"], 6) for x in mixing.source_targets(docs.selectExpr("source", "size(split(trim(text), ' ')) AS size")).collect()} == {"a": 30.0, "b": 120.0, "c": 60.0}


def test_kept_bytes_have_their_digest(spark):
    from tidelens.llm import queries

    got = {x["doc_id"]: x for x in queries.op8_suffix_repeats(spark, "/root/testdata/sf0.001").collect()}
    raw = {x["doc_id"]: (x["text"] or "").encode() for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert got.keys() == raw.keys()
    for (i, t), found in zip(raw.items(), spans(list(raw.values()), 400, "none"), strict=True):
        kept = b"".join(t[a:b] for a, b in zip([0, *[s[1] for s in found]], [*[s[0] for s in found], len(t)], strict=True))
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(t), len(t) - len(kept), len(found), hashlib.sha256(kept).hexdigest())
    assert any(x["n_removed"] for x in got.values())


def test_strings_that_trick_a_power_of_two_are_no_copies(spark):
    bits = np.array([i.bit_count() & 1 for i in range(4096)], np.uint8)
    one, other = (97 + bits).tobytes().decode(), (98 - bits).tobytes().decode()
    roll = suffix_dedup.Rolling(np.frombuffer((one + other).encode(), np.uint8))
    for n in (512, 1024, 2048, 4096):
        assert roll(np.array([0]), np.array([n])) != roll(np.array([4096]), np.array([4096 + n]))
    texts = [one[:1024] + "x", other[:1024] + "y", one[:1024] + "z"]
    got = suffix_dedup.repeats(table(spark, texts), 1024).orderBy("doc_id").collect()
    assert [len(x["kept"]) for x in got] == [1, 1025, 1]


def test_a_passage_of_400_bytes_goes_and_a_shorter_one_stays(spark):
    texts = [words(rng(20 + i), 100) for i in range(6)]
    long, short = words(rng(30), 200)[:400], words(rng(31), 200)[:399]
    texts = [t + ("#" + long + "#" if i < 3 else "%" + short + "%") + texts[5 - i] for i, t in enumerate(texts)]
    got = suffix_dedup.repeats(table(spark, [*texts, None, ""])).orderBy("doc_id").collect()
    for i, t in enumerate(texts):
        gone = b"".join(t.encode()[s["a"] : s["b"]] for s in got[i]["spans"] or [])
        assert (long.encode() in gone) == (i < 3) and (short.encode() in gone) is False or i >= 3
    assert suffix_dedup.repeats(table(spark, [])).count() == 0 and [x["n_bytes"] for x in got[6:]] == [0, 0]


def test_lines_are_linked_by_edit_similarity_alone(spark):
    r = rng(10)
    texts = []
    for n in (2, 3, 5, 8, 10, 12, 20, 35, 50):
        for _ in range(12):
            line = words(r, n).split()
            texts.append(" ".join(line))
            line[int(r.integers(n))] += "q"
            if n >= 8:
                line[int(r.integers(n))] = "hij"
            texts.append(" ".join(line))
    gone = {x["of"] for x in line_dedup.removed_lines(table(spark, texts), 2, distance=None).collect()}
    near = [i for i in range(1, len(texts), 2) if line_dedup.similar(texts[i - 1], texts[i])]
    far = [(line_dedup.simhashes(b"".join(map(xxhash.xxh64_digest, t.encode().split())), np.array([len(t.split())]))[0]) for t in texts]
    assert sum((int(far[i]) ^ int(far[i - 1])).bit_count() > 3 for i in near) > 60
    found = sum(i in gone for i in near)
    assert found >= 0.97 * len(near) and len(near) > 80
    alone = [i for i in range(len(texts)) if not any(line_dedup.similar(texts[i], t) for j, t in enumerate(texts) if j != i)]
    assert not gone & set(alone)
    tiny = ["abcdefgh", "abcdxefgh", "ab cdefghij", "ab cdefgxxij", "abcd", "abce"]
    got = {x["of"] for x in line_dedup.removed_lines(table(spark, tiny), 1, distance=None).collect()}
    assert got == {1, 3}


def test_large_keys_lose_no_pair(spark, monkeypatch):
    texts = ["one long line of words that many share " + words(rng(i), 1) for i in range(60)]
    monkeypatch.setattr(line_dedup, "GROUP", 4)
    monkeypatch.setattr(line_dedup, "SET", 3)
    assert len({x["of"] for x in line_dedup.removed_lines(table(spark, texts), distance=None).collect()}) == 59


def test_large_sets_are_dealt_in_proportion_to_their_lines(spark, monkeypatch):
    r, written = rng(21), {}
    write = line_dedup.materialise

    def counted(df, tag):
        out = write(df, tag)
        written[tag] = written.get(tag, 0) + out.count()
        return out

    monkeypatch.setattr(line_dedup, "materialise", counted)
    monkeypatch.setattr(line_dedup, "GROUP", 8)
    monkeypatch.setattr(line_dedup, "SET", 4)
    monkeypatch.setattr(line_dedup, "SHARED", 2)
    copies = ["one long line of words that many share and each of them ends in " + words(r, 1) for _ in range(200)]
    assert len({x["of"] for x in line_dedup.removed_lines(table(spark, copies), distance=None).collect()}) == len(copies) - 1
    # Each of the set's lines comes to its block, some to all; its links are no more than those rows.
    assert written["candidates"] < 6 * len(copies) and written["verified"] < 6 * len(copies)
    assert written.get("unlinked", 0) < 6 * len(copies)
    # Lines of four groups that share a passage, and some of no group: whatever the blocks, the groups are those of all pairs.
    heads = [words(r, 12) for _ in range(4)]
    mixed = [f"{heads[i % 4]} a passage that is common {words(r, 1)}" for i in range(60)]
    mixed += [f"{words(r, 9)} a passage that is common" for _ in range(12)]
    up = list(range(len(mixed)))
    for i in range(len(mixed)):
        for j in range(i):
            if line_dedup.similar(mixed[i], mixed[j]):
                up = [up[j] if x == up[i] else x for x in up]
    gone = {x["of"] for x in line_dedup.removed_lines(table(spark, mixed), distance=None).collect()}
    assert gone == {i for i in range(len(mixed)) if up.index(up[i]) != i} and 40 < len(gone) < 72


def test_links_between_parts_join_lines_of_one():
    import pyarrow as pa

    near, far = "abcdefgh ijkl mnop qrst", "zzzz yyyy xxxx wwww vvvv"
    rows = [(0, 0, 0, 1, 1, near, 1), (0, 0, 0, 1, 2, near + "a", 1), (0, 0, 0, 1, 3, near + "b", 7), (0, 0, 0, 1, 4, far, 7), (0, 0, 0, 1, 5, far + "a", 5)]
    c = list(zip(*rows, strict=True))
    batch = pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in c[:5]], pa.array([x.encode() for x in c[5]]), pa.array(c[6], pa.int64())], ["near", "key", "a", "b", "node", "text", "part"])
    (out,) = line_dedup._spanned(0.8)(iter([batch]))
    assert sorted(tuple(sorted(x)) for x in zip(*[y.to_pylist() for y in out.columns], strict=True)) == [(1, 7), (5, 7)]


def test_short_lines_take_part(spark):
    texts = ["les.\nand ornd.", "Les\nx y z w", "and ornd\n--\n\nles", "--\n\nx y z w!"]
    for distance in (3, None):
        got = line_dedup.drop_repeated_lines(table(spark, texts), distance=distance).orderBy("doc_id").collect()
        assert [x["text"] for x in got] == ["les.\nand ornd.", "x y z w", "--\n", "--\n"]


def test_repeated_rows_keep_one_occurrence_of_a_line(spark):
    docs = table(spark, ["a b c\nd e", "a b c\nd e", "a b c\nd e", "q\n\nd e", "q\n\nd e", "zz\n"], [1, 1, 2, None, None, 3])
    got = line_dedup.drop_repeated_lines(docs, distance=None).collect()
    assert sorted((x["doc_id"] or 0, x["text"]) for x in got) == [(0, ""), (0, "q\n\nd e"), (1, ""), (1, "a b c"), (2, ""), (3, "zz\n")]


def test_one_row_stays_of_a_group_with_null_ids(spark):
    docs = table(spark, ["a b c", "a b c", "A b  c", "q r s t", "q r s t", "zz yy", None, ""], [7, None, None, None, None, 9, None, None])
    got = simhash_dedup.keep_one(docs).collect()
    assert sorted((x["doc_id"] or 0, x["text"] or "") for x in got) == [(0, ""), (0, "q r s t"), (7, "a b c"), (9, "zz yy")]


def test_one_row_stays_of_each_group_with_repeated_ids(spark):
    texts = ["q r s t u v", "q r s t u v", "one two three four", "one two three four", "one two three four", "x"]
    got = simhash_dedup.keep_one(table(spark, texts, [2, 4, 4, 4, 4, None])).collect()
    assert sorted((x["doc_id"] or -1, x["text"]) for x in got) == [(-1, "x"), (2, "q r s t u v"), (4, "one two three four")]
    maps = table(spark, texts).selectExpr("doc_id", "text", "map(text, n) AS `a b`", "array(doc_id) AS __part")
    assert sorted(x["doc_id"] for x in simhash_dedup.keep_one(maps).collect()) == [0, 2, 5] and simhash_dedup.keep_one(maps).columns == maps.columns


def test_empty_tables_and_long_texts_have_fingerprints(spark):
    none = table(spark, [])
    assert simhash_dedup.near_duplicates(none).count() == 0 and simhash_dedup.keep_one(none).columns == none.columns and simhash_dedup.keep_one(none).count() == 0
    long = words(rng(11), 2000) * 200
    got = {x["doc_id"]: x for x in simhash_dedup.near_duplicates(table(spark, [long, long + " z", "z"])).collect()}
    assert len(long) > 1_000_000 and got[0]["bits"] % 2**64 == simhash(long) and [got[i]["component_id"] for i in range(3)] == [0, 0, 2]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_special_tokens_in_a_text_get_the_librarys_ids(name):
    from tidelens.llm._tokens import encoder

    path = public_tokenizers.path(name)
    t = Tokenizer.from_file(path)
    specials = [x.content for x in t.get_added_tokens_decoder().values()]
    texts = ["x <|endoftext|> a", "plain words", *[f"a{s}b" for s in specials], *[f"A b {s.upper()} c" for s in specials], *specials]
    assert list(encoder(path).encode(texts)) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_ids_that_do_not_fit_are_no_other_ids(monkeypatch, spark):
    with pytest.raises(ValueError):
        token_files._narrow(np.array([1, 65_536], "<u4").tobytes(), 2)
    path, folder = public_tokenizers.path("word_bpe_49k.json"), scratch(spark, "test")
    assert token_files.id_width(path, 1) == 2
    token_files.write_tokens(table(spark, ["a b"]), folder, path, end_id=70_000)
    assert np.frombuffer(token_files.read_tokens(spark, folder).first()["ids"], "<u4")[-1] == 70_000
