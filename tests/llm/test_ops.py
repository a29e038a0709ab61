"""Each operator against brute force, an exact round trip or held-out accuracy."""

import hashlib
import io
import itertools
import json
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from millrace.llm import chat, classifier, common, components, decontam, lines, mixing, queries, rules, simhash, substrings, tokens, warc
from tests.llm.samples import DOCS, documents

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def same(a, b):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, a), key=key) == sorted(map(tuple, b), key=key)


@pytest.fixture(scope="module")
def rows():
    return documents()


# names that operators return or use for columns of their own
CLASHES = """size score mark row fp key band id line_no name norm root node source_size target copies taken weight plan tie extra task n_words n_hit n_items
stats d k m t r h s q n at hash low around start stop words shingles ranges digest mini salt index part file path base group segment keeper component_id
__d __m __k __n __s __p __r __i __size __mark __row __key __plan __copies __stats __words __hashes __windows __twice __at __marks __lines __words_marks
__words_lines __removed __score __difference __ratio __barrier __id __part __base kept base_failed held_out predicted difference ratio""".split()


def clashing(df):
    return df.withColumns({c: F.lit(k).cast("string" if k % 3 else "int") for k, c in enumerate(CLASHES)})


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With extra columns whose names clash with what operators return or use."""
    return clashing(spark.createDataFrame(rows, DOCS)).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_word_tables(rows):
    for _, text, *_ in rows:
        raw = (text or "").encode()
        s, e, h = common.word_table(raw, False)
        assert [raw[a:b] for a, b in zip(s, e)] == [w.encode() for w in SPACE.findall(text or "")]
        s, e, h = common.word_table(common.lowered(raw), True)
        words = LETTERS.findall(lower(text or ""))
        assert [common.lowered(raw)[a:b].decode() for a, b in zip(s, e)] == words
        assert len(set(h.tolist())) == len(set(words))


def test_word_table_in_pieces(monkeypatch):
    raw = ("wörd " * 50 + "x" * 300 + " end").encode()
    whole = common.word_table(raw, False)
    monkeypatch.setattr(common, "_CHUNK", 64)
    for a, b in zip(whole, common.word_table(raw, False)):
        assert a.tolist() == b.tolist()


# 1


def waterfill(sizes, cycle=(1, 2, 3)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: cycle[k % len(cycle)] for k, s in enumerate(order)}
    total, target = sum(sizes.values()), {}
    free = set(order)
    while True:
        rest = total - sum(target.values())
        level = rest / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
        free -= over


@pytest.mark.parametrize("few", [None, 3])
def test_mix(spark, rows, few):
    data = rows[:few] + [(k, "w " * 7, "en", "tiny", 1) for k in range(2000, 2003)] if few else rows
    df = spark.createDataFrame(data, DOCS)
    out = mixing.mix(df).collect()
    same([(r["doc_id"], r["size"]) for r in out], [(r[0], len(SPACE.findall(r[1] or ""))) for r in data])
    sizes, taken, biggest = Counter(), Counter(), Counter()
    for r in data:
        sizes[r[3]] += len(SPACE.findall(r[1] or ""))
        biggest[r[3]] = max(biggest[r[3]], len(SPACE.findall(r[1] or "")))
    want = waterfill(sizes)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9)
        assert r["taken"] in {k * r["size"] for k in range(4)}
        taken[r["source"]] += r["taken"]
        if r["size"]:
            assert r["copies"] >= int(r["target"] / r["source_size"] + 1e-9)  # complete epochs come first
    for s in sizes:
        assert abs(taken[s] - want[s]) <= biggest[s] * 3
    same(out, mixing.mix(df).collect())


def brute_mix(rows, weights, cycle=(1, 2, 3)):
    """``rows``: (source, size, mark). Copies of each, from keys recomputed here: whole epochs, then the prefix in key order that comes nearest to the target."""

    def signed(x):
        return x - (1 << 64) if x >= 1 << 63 else x

    def key(mark, weight):  # Spark's xxhash64 of (seed, mark): each hashes eight bytes (four for an int), seeded with the hash so far
        h = xxhash.xxh64_intdigest(struct.pack("<i", mixing.SEED), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<q", mark), h)
        return -math.log(((h >> 11) + 0.5) / (1 << 53)) / weight

    by, copies = defaultdict(list), [0] * len(rows)
    for k, ((source, size, mark), w) in enumerate(zip(rows, weights)):
        by[source].append((key(mark, w), signed(mark) if mark >= 0 else mark, size, k))
    goal = waterfill({s: sum(x[2] for x in v) for s, v in by.items()}, cycle)
    for source, v in by.items():
        total = sum(x[2] for x in v)
        epochs = int(goal[source] / total + 1e-12) if total else 0
        rest, done = goal[source] - epochs * total, 0
        for _, _, size, k in sorted(v):
            if size:
                more = done + size / 2 <= rest
                copies[k] = epochs + more
                done += size * more
                rest = rest if more else -1
    return copies, goal


@pytest.mark.parametrize("cycle", [(1, 2, 3), (1, 5)])
def test_mix_takes_the_prefix_of_key_order(spark, cycle):
    """Every key, target and selection recomputed by brute force, with weights."""
    data = [(k, "w " * (1 + k % 13), "en", "abc"[k % 7 % 3], 1) for k in range(3000)]
    df = spark.createDataFrame(data, DOCS).repartition(5)
    weight = F.when(F.col("doc_id") % 2 == 0, 0.2).otherwise(0.9)
    out = mixing.mix(df, quality=weight, cycle=cycle).collect()
    weights = [0.2 if r["doc_id"] % 2 == 0 else 0.9 for r in out]
    copies, goal = brute_mix([(r["source"], r["size"], r["mark"]) for r in out], weights, cycle)
    assert [r["copies"] for r in out] == copies
    for r in out:
        assert math.isclose(r["target"], goal[r["source"]], rel_tol=1e-9)
    for s in goal:
        assert abs(sum(r["taken"] for r in out if r["source"] == s) - goal[s]) <= 6.5
    # heavier documents are chosen more readily
    light, heavy = (np.mean([r["copies"] for r, w in zip(out, weights) if w == x]) for x in (0.2, 0.9))
    assert heavy > light


@pytest.mark.parametrize("tied", [(5, "w " * 10, "en", "a", 1), (None, "w " * 10, None, "a", None)])
def test_mix_cuts_ties_at_the_budget(spark, tied):
    data = [tied] * 100 + [(k, "w " * (8 + k % 5), "en", "b", 1) for k in range(1000, 1300)]
    df = spark.createDataFrame(data, DOCS).repartition(7)
    out = mixing.mix(df).collect()
    for s in "ab":
        rs = [r for r in out if r["source"] == s]
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= 6
        assert max(r["copies"] for r in rs) - min(r["copies"] for r in rs) <= 1
    assert Counter(r["doc_id"] for r in mixing.mixed(df).collect()) == +sum((Counter({r["doc_id"]: r["copies"]}) for r in out), Counter())
    same([tuple(r)[:3] + tuple(r)[5:] for r in out], [tuple(r)[:3] + tuple(r)[5:] for r in mixing.mix(df.repartition(2)).collect()])


def test_slices_are_even(spark):
    """No slice of keys holds more than its bound, whatever the weights."""
    rows = spark.range(200_000).select(mixing._key(F.xxhash64("id"), F.element_at(F.array(F.lit(1.0), F.lit(0.1), F.lit(0.01)), (F.col("id") % 3 + 1).cast("int"))).alias("key"))
    most = rows.groupBy(F.floor(F.log2("key") * 64).alias("s")).count().agg(F.max("count")).first()[0]
    assert most <= 200_000 * (2 ** (1 / 64) - 1) / math.e * 1.3


def test_mixed_rows(spark, docs, rows):
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r["doc_id"], r["size"]] += r["copies"]
    got = Counter((r["doc_id"], len(SPACE.findall(r["text"] or ""))) for r in mixing.mixed(docs).collect())
    assert got == +want
    assert mixing.mixed(docs).columns == docs.columns


# 2


def test_chat_round_trip(spark):
    said = ["", "\\", "\\b", "###", "####", "### user: x</turn>\n", "</turn></turn>", "a\\t\\h", "é中\n", None, "</turn", "#", "x" * 3000]
    rng = random.Random(3)
    data = [(c, t if c else None, rng.choice(["user", "assistant", "system", "a: b", None, "###"]), rng.choice(said)) for c in [1, 2, None, 3] for t in range(25)] + [(1, 3, "user", "again")] * 2
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("turns", "said", "coded", "formatted", "mask", "lines", "loss")})
    back = {r["conv_id"]: r for r in chat.read_back(chat.formatted(chat.canonical(df))).collect()}
    for c in {r[0] for r in data}:
        turns = sorted(((t is not None, t, role or "", text or "") for i, t, role, text in data if i == c), key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == [x[2:] for x in turns]
        assert back[c]["loss"] == "".join(x[3] for x in turns if x[2] == "assistant")


def test_chat_layouts(spark):
    data = [
        ('{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}', [("user", "q"), ("assistant", "a")]),
        ('{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "extra": 1}', [("user", "q"), ("assistant", "a")]),
        ('{"instruction": "i", "input": "x", "output": "o"}', [("user", "i\nx"), ("assistant", "o")]),
        ('{"instruction": "i", "output": "o"}', [("user", "i"), ("assistant", "o")]),
        ('{"completion": "c", "prompt": "p"}', [("user", "p"), ("assistant", "c")]),
        ('{"messages": [{"role": "user", "content": null}, {"role": null, "content": "a"}]}', [("user", ""), ("", "a")]),
        ('{"prompt": null, "response": "a"}', [("user", ""), ("assistant", "a")]),
        ('{"messages": []}', []),
        ('{"strange": 1}', None),
        ("no json", None),
        (None, None),
    ]
    df = spark.createDataFrame([(k, j) for k, (j, _) in enumerate(data)], "id long, j string")
    out = {r["conv_id"]: r["turns"] for r in chat.canonical_json(df, "j", "id").collect()}
    for k, (_, want) in enumerate(data):
        assert (out[k] and [(t["role"], t["text"]) for t in out[k]]) == want
    whole = spark.createDataFrame([(7, "p", "r", 1)], "conv_id long, prompt string, response string, other int")
    assert [(t["role"], t["text"]) for t in chat.canonical(whole).first()["turns"]] == [("user", "p"), ("assistant", "r")]
    with pytest.raises(ValueError):
        chat.canonical(spark.range(1))


def test_chat_is_native(spark, sf):
    plan = queries.op2_chat_format(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# 3


def contaminated(rows, items):
    windows = defaultdict(set)
    for item, text in items:
        words = LETTERS.findall(lower(text or ""))
        if item is not None:
            for i in range(max(1, len(words) - 9) if words else 0):
                windows[tuple(words[i : i + 10])].add(str(item))
    out = []
    for doc_id, text, *_ in rows:
        words = LETTERS.findall(lower(text or ""))
        hit, found = set(), set()
        for w, ids in windows.items():
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i : i + len(w)]) == w:
                    hit.update(range(i, i + len(w)))
                    found |= ids
        out.append((doc_id, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("bits", [None, 1 << 15])
def test_decontamination(spark, rows, docs, monkeypatch, bits):
    if bits:  # a bitmap so full that it lets nearly everything through
        monkeypatch.setattr(decontam, "BITMAP", bits)
        monkeypatch.setattr(decontam, "FLUSH", 50)
    words = [LETTERS.findall(r[1] or "") for r in rows]
    items = [(k, " ".join(w[3 : 3 + n]).upper()) for k, (w, n) in enumerate(zip(words, [1, 2, 4, 5, 9, 10, 11, 30] * 4))]
    items += [(100, None), (101, " - "), (None, "nothing here"), (2, "the second text of an id"), (102, items[7][1]), (10, items[9][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x"))
    got = decontam.contamination(docs, bench).collect()
    same(got, contaminated(rows, items))
    clean = decontam.clean(docs, bench)
    assert clean.columns == docs.columns
    assert clean.count() == sum(not x[-1] for x in contaminated(rows, items))


def test_decontamination_of_nested_and_repeated_items(spark):
    """Items within items, at all offsets, repeated under other ids; documents with a passage twice, and whole in a very long text."""
    w = [f"w{chr(97 + k)}" for k in range(20)]
    text = " ".join(w)
    items = [(1, " ".join(w[4:10])), (2, " ".join(w[4:10])), (3, " ".join(w[4:14]))]
    rng = random.Random(5)
    for k in range(4, 60):
        a = rng.randrange(20)
        items.append((k, " ".join(w[a : a + rng.randint(1, 14)])))
    data = [(1, text), (2, f"{text}; {text}"), (3, "x " * 150_000 + text + " y" * 1000), (4, " ".join(w[4:9])), (5, " ".join(w[::-1])), (2, f"{text}; {text}"), (None, text)]
    for few in (items[:3], items):
        got = decontam.contamination(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(few, "item_id long, text string")).collect()
        same(got, contaminated(data, few))
    assert [(r["n_hit"], r["n_items"]) for r in decontam.contamination(spark.createDataFrame(data[:1], "doc_id long, text string"), spark.createDataFrame(items[:3], "item_id long, text string")).collect()] == [(10, 3)]


# 4


def test_tokens(spark, rows, docs):
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    vocabulary = Tokenizer.from_file(path)
    ids = lambda t: [*vocabulary.encode(t or "", add_special_tokens=False).ids, 2]
    start, want = 0, []
    with_marks = rows + [(2000, "a<|endoftext|> b  <|endoftext|>\n\n  c 's don't 12a", "", "", 0), (2001, " 　x  y\x1c z×÷ ﬁ", "", "", 0)]
    df = spark.createDataFrame(with_marks, DOCS)
    key = {(r["doc_id"], r["text"]): r["h"] for r in df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    for r in sorted(with_marks, key=lambda r: (r[0] is not None, r[0] or 0, key[r[0], r[1]])):
        x = ids(r[1])
        want.append((r[0], start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    for bits, file_ids in ((False, tokens.FILE_IDS), (True, 1000)):
        manifest = tokens.write_tokens(clashing(df), path, block=64, bits=bits, file_ids=file_ids)
        same(tokens.read_digests(manifest).collect(), want)
        assert (manifest.count() > 4) == bits  # files roll over


def test_tokens_of_a_long_text(spark):
    from tokenizers import Tokenizer

    text = "no break " + "x" * 3000 + " " + "word. " * 200_000 + "  end"
    ids = [*Tokenizer.from_file(queries.vocabulary()).encode(text, add_special_tokens=False).ids, 2]
    out = tokens.read_digests(tokens.write_tokens(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), queries.vocabulary())).collect()
    same(out, [(1, 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), (2, len(ids), 1, zlib.crc32(np.array([2], "<u4").tobytes()))])


def test_stretches_of_words_get_the_ids_of_the_file():
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    plain, encode = Tokenizer.from_file(path), tokens.encoder(path)
    assert len(encode.tokenizer.pre_tokenizer.pre_tokenize_str("Words, 12 of them.\nIn 2 lines")) == 1
    rng = random.Random(4)
    odd = [*"abcstdmlrevABZ  \n\n\t\r019'''.,!-\"&[]{}~`_éèàüßÀɏ×÷ …—²½\u0301\u200b\u00a0жя中の醒ーא\x1c\x85\x00😀İ", "'s", "'ll", " '", "  ", "\n ", " the", "[…]", ".—", "<|endoftext|>"]
    words = [w for w in map(plain.decode, ([i] for i in range(0, 50_000, 25))) if "\ufffd" not in w]
    texts = ["".join(rng.choice(odd if rng.random() < k % 3 / 2 else words) for _ in range(rng.randrange(40))) for k in range(9000)]
    texts += ["".join(x) for x in itertools.product("a1.' \né—", repeat=4)]
    want = [np.array(x.ids, "<u4").tobytes() for x in plain.encode_batch_fast(texts, add_special_tokens=False)]
    assert list(encode([t.encode() for t in texts])) == want


@pytest.mark.parametrize("merges", [["a."], [".a"], ["1a"], ["a1"], ["a\u0120"], [".\u010a"], ["\u010aa"], ["\u00a9."], [".\u00c3"], ["\u00c3\u00a9", "\u00c3\u00a9."]])
def test_vocabularies_whose_tokens_cross_words_are_split_as_the_file_says(merges, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    def saved(name, merges, **more):
        t = Tokenizer(models.BPE({x: k for k, x in enumerate([*tokens.byte_alphabet(), *merges])}, [(x[:-1], x[-1]) for x in merges], **more))
        t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
        t.save(str(tmp_path / name))
        return str(tmp_path / name)

    takes = lambda path: tokens.takes_stretches(json.loads(Tokenizer.from_file(path).to_str()))
    bad = saved("bad", merges)
    assert (takes(saved("good", ["ab", "\u0120a", "..", "12"])), takes(bad), takes(saved("whole", [], ignore_merges=True))) == (True, False, False)
    text = "a.a1a a.\na1.a.\na1\né.é"
    assert list(tokens.Encoder(bad)([text.encode()])) == [np.array(Tokenizer.from_file(bad).encode(text).ids, "<u4").tobytes()]


def test_planes_random_access():
    ids = np.random.default_rng(1).integers(0, 1 << 32, 1000, dtype=np.uint32)
    for bits in (False, True):
        out = io.BytesIO()
        w = tokens.PlaneWriter(out, 128, bits, segment=5)
        for k in range(0, 1000, 37):
            w.add(k or None, ids[k : k + 37].tobytes())
        w.close()
        r = tokens.PlaneReader(out)
        assert [d for d, _ in r.documents()] == [None, *range(37, 1000, 37)]
        assert np.array_equal(r.ids(3), ids[384:512])
        assert np.array_equal(np.concatenate([x for _, x in r.documents()]), ids)


# 5


def jaccard(a, b):
    f = lambda x: {x[k : k + lines.SHINGLE] for k in range(max(1, len(x) - lines.SHINGLE + 1))}
    a, b = f(a), f(b)
    return len(a & b) / len(a | b)


def test_fuzzy_lines(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([3, 20, 60, 90, 260]))) for _ in range(25)]
    data, k = [], 0
    for _ in range(40):
        text = []
        for _ in range(rng.randint(0, 6)):
            x = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                x[rng.randrange(len(x))] = rng.choice("xyzé")
            text.append("".join(x) if rng.random() < 0.8 else "  ".join("".join(x).upper().split(" ")))
        data.append((k, "\n".join([*text, ""]), "en", "s", 1))
        k += 1
    data += [(None, data[0][1], "", "", 0), (900, None, "", "", 0), data[3]]
    norm = lambda x: " ".join(x.split()).lower()
    all_lines = {norm(x) for r in data for x in (r[1] or "").split("\n") if x.strip()}
    parent = {x: x for x in all_lines}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in all_lines:
        for b in all_lines:
            if jaccard(a, b) >= lines.SIMILARITY:
                parent[find(a)] = find(b)
    df = spark.createDataFrame(data, DOCS)
    marks = {(r["doc_id"], r["text"]): r["m"] for r in df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("m")).collect()}
    first = {}
    place = lambda r, i: (r[0] is None, r[0] or 0, marks[r[0], r[1]], i)
    for r in data:
        for i, x in enumerate((r[1] or "").split("\n")):
            if x.strip():
                first[find(norm(x))] = min(first.get(find(norm(x)), place(r, i)), place(r, i))
    want = [(r[0], len((r[1] or "").split("\n")), [i for i, x in enumerate((r[1] or "").split("\n")) if x.strip() and first[find(norm(x))] != place(r, i)]) for r in data]
    same([(r["doc_id"], r["n_lines"], r["removed"]) for r in lines.decisions(clashing(df)).collect()], want)
    left = {(r[0], r[1]): "\n".join(x for i, x in enumerate((r[1] or "").split("\n")) if i not in w[2]) if w[2] else r[1] for r, w in zip(data, want)}
    same([(r["doc_id"], r["text"]) for r in lines.deduplicated(clashing(df)).collect()], [(r[0], left[r[0], r[1]]) for r in data])


# 6


def substring_truth(rows, window=50):
    least = {}
    split = [SPACE.findall(r[1] or "") for r in rows]
    for r, w in zip(rows, split):
        for i in range(len(w) - window + 1):
            if r[0] is not None:
                t = tuple(w[i : i + window])
                least[t] = min(least.get(t, r[0]), r[0])
    out = []
    for r, w in zip(rows, split):
        gone = set()
        for i in range(len(w) - window + 1):
            if r[0] is not None and least[tuple(w[i : i + window])] < r[0]:
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((r[0], len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("salt_over", [256, 1, 3])
def test_substrings(spark, rows, docs, monkeypatch, salt_over):
    monkeypatch.setattr(substrings.covered, "__defaults__", (50, 8, salt_over))
    same(substrings.removals(docs).collect(), substring_truth(rows))


def test_super_kmers_cover_each_window_once():
    h = np.random.default_rng(0).integers(0, 50, 500).astype(np.uint64)
    mini, first, count = substrings.super_kmers(h)
    assert first[0] == 0 and np.array_equal(first[1:], np.cumsum(count)[:-1]) and count.sum() == 451
    grams = common.mix64(common.window_hashes(h, 8))
    assert all(grams[s : s + 43].min() == m for m, f, n in zip(mini, first, count) for s in range(f, f + n))


# 7


def brute_fingerprint(text):
    words = SPACE.findall(lower(text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def closed(prints):
    label = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                x, y = label[i], label[j]
                label = [min(x, y) if z in (x, y) else z for z in label]
    return label


def test_simhash(spark, rows, docs):
    got = simhash.near_duplicates(docs).collect()
    prints = [brute_fingerprint(r[1]) for r in rows]
    label = closed(prints)
    ids = defaultdict(list)
    for r, c in zip(rows, label):
        ids[c].append(r[0])
    least = {c: min((x for x in v if x is not None), default=None) for c, v in ids.items()}
    same([(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got], [(r[0], p, least[c]) for r, p, c in zip(rows, prints, label)])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    alone = {c: min(((r[0] is None, r[0] or 0) for r, x in zip(rows, label) if x == c)) for c in label}
    same([(r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()], alone.values())


def test_bitmaps(spark):
    """A value's bit is set; in the JVM and in numpy alike, and others' are as the bitmap is full."""
    df = spark.range(2000).select(F.xxhash64("id").alias("v"), "id")
    made = common.bitmap_rows(df.where("id < 100"), "v", 1 << 16)
    flagged, name = common.with_bit(df, F.col("v"), made, 1 << 16)
    got = {r["id"]: r[name] for r in flagged.collect()}
    assert all(got[k] for k in range(100)) and sum(got.values()) < 110 and flagged.columns == ["v", "id", name]
    values = np.array([r["v"] for r in df.orderBy("id").collect()]).view(np.uint64)
    assert common.in_bitmap(common.bitmap_of(df.where("id < 100"), "v", 1 << 16), values).tolist() == [got[k] for k in range(2000)]
    assert not common.in_bitmap(common.bitmap_of(df.limit(0), "v", 1 << 16), values).any()


def test_keep_one_of_equal_ids(spark):
    """Rows equal in id and text, but not elsewhere, and rows equal in all: one stays, the same one however they lie."""
    data = [(1, "a b c d", "en", s, 1) for s in "pqrst"] + [(2, "e f g h", "de", "x", 1)] * 5 + [(None, "i j k", "en", "n", 1), (None, "i j k", "en", "m", 1), (3, "A B C D", "en", "p", 1)]
    got = [sorted(map(str, simhash.keep_one(spark.createDataFrame(data, DOCS).repartition(n)).collect())) for n in (1, 2, 5)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 3


def test_fingerprints_side_by_side(monkeypatch):
    """Hashes of pieces of all lengths, and fingerprints of short and long texts, are those made one by one."""
    rng = random.Random(7)
    raw = bytes(rng.randrange(256) for _ in range(3000))
    starts = np.array([rng.randrange(2800) for _ in range(800)] + [3000, 2999])
    ends = np.minimum(starts + np.array([rng.randrange(140) for _ in range(800)] + [0, 1]), 3000)
    assert simhash.xxh64_many(raw, starts, ends).tolist() == [xxhash.xxh64_intdigest(raw[a:b], 42) for a, b in zip(starts, ends)]
    texts = ["", " \n", "One", "one two", "a b c", "a b c d"] + [" ".join(rng.choice(["ab", "Ä中", "x" * 40, "y", "ZZ"]) + rng.choice(["", "\t", "\n "]) for _ in range(rng.choice([3, 4, 200, 257, 258, 600, 3000]))) for _ in range(60)]
    raws = [t.encode() for t in texts]
    want = [simhash.fingerprint(t) for t in raws]
    assert want[:12] == [brute_fingerprint(t) for t in texts[:12]]
    for together in (1 << 19, 700, 1):
        monkeypatch.setattr(simhash, "_TOGETHER", together)
        assert simhash.fingerprints_of(raws).tolist() == want


def test_ball_links_are_whole():
    """All links within a radius, from dense and sparse sets, through both ways of a bucket."""
    rng = random.Random(4)
    for spread, n in ((3, 60), (1, 150), (12, 100)):
        centre = rng.getrandbits(64)
        prints = {centre}
        while len(prints) < n:
            x = rng.choice(sorted(prints)) if spread == 1 else centre
            for _ in range(rng.randint(1, spread)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
        prints = sorted(prints)
        buckets = defaultdict(set)
        for k, block in enumerate(simhash.BLOCKS):
            for p in prints:
                base = p & ~int(simhash._LEFT_OUT[k]) & (1 << 64) - 1
                for m in [0, *(1 << b for b in range(64) if b not in block)]:
                    buckets[k, base ^ m].add(p)
        links = set()
        for (k, v), members in buckets.items():
            if len(members) > 1:
                a, b = simhash.bucket_links(v, k, np.array(sorted(members), np.uint64))
                links |= set(zip(a.tolist(), b.tolist()))
        label = {p: p for p in prints}

        def find(x):
            while label[x] != x:
                x = label[x]
            return x

        for a, b in links:
            label[find(a)] = find(b)
        want = closed(prints)
        got = {p: find(p) for p in prints}
        assert {frozenset(p for p in prints if got[p] == g) for g in got.values()} == {frozenset(p for p, w in zip(prints, want) if w == c) for c in want}


def test_components(spark):
    rng = random.Random(6)
    links = [(k, k + 1) for k in range(100, 140)] + [(500, k) for k in range(501, 560)] + [(rng.randrange(1000, 1040), rng.randrange(1000, 1040)) for _ in range(30)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    label = {x: x for e in links for x in e}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {k: v for k, v in label.items() if any(a != b and k in (a, b) for a, b in links)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 8


def test_classifier(spark, docs):
    d, labels = (queries.table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    out = classifier.classify(d, labels)
    assert {r["doc_id"]: r["held_out"] for r in out.collect()} == {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in d.select("doc_id").collect()}
    marked = out.where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in marked]) > 0.9
    # labels of the held-out fold are never read
    changed = labels.withColumn("quality", F.when(classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    same(out.collect(), classifier.classify(d, changed).collect())
    none = classifier.classify(docs, labels.limit(0)).collect()
    assert len(none) == docs.count() and {r["score"] for r in none} == {0.5}
    scored, name = classifier.fit(d, labels).with_scores(docs)
    odd = scored.collect()
    assert scored.columns == [*docs.columns, name] and len(odd) == docs.count() and all(0 <= r[name] <= 1 for r in odd)
    # equal texts score alike, ids and repeated rows or not
    by = defaultdict(set)
    for r in odd:
        by[r["text"] or ""].add(r[name])
    assert all(len(v) == 1 for v in by.values()) and len(by) < len(odd)


def test_classifier_score_by_brute_force(spark):
    """The score is what compressed sizes and the calibration say."""
    good, bad = b"the quick brown fox jumps over the lazy dog " * 40, b"#### $$$$ %%%% &&&& " * 60
    model = classifier.Model(good, bad, [0.3, -8.0, 1.5], 0.5)
    texts = ["the quick brown fox", "#### $$$$ %%%%", "", None, "other words altogether " * 300]
    out = {r["doc_id"]: r["score"] for r in model.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, text in enumerate(texts):
        raw, sizes = (text or "").encode(), []
        for data in (good, bad):
            press = zstandard.ZstdCompressor(level=classifier.LEVEL, dict_data=zstandard.ZstdCompressionDict(data), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(press.compress(raw[i : i + classifier.CHUNK])) for i in range(0, len(raw), classifier.CHUNK)))
        g, b = sizes
        x = (g - b) / (g + b) if raw else 0.0, min(g, b) / len(raw) if raw else 1.0
        assert math.isclose(out[k], 1 / (1 + math.exp(-(0.3 - 8 * x[0] + 1.5 * x[1]))), rel_tol=1e-9)
    assert out[0] > out[1]


# 9


def test_warc(spark):
    rng = random.Random(9)
    html = ["x" * 99, "y" * 100, "é" * 60, None, "", "long " * 60_000, "WARC/1.0\r\n\r\n" * 20]
    data = [(k, f"http://a/{k} b", rng.choice(html)) for k in range(60)] + [(None, None, "y" * 100), (None, None, "only " * 40), (3, "u", "y" * 100)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)
    df = clashing(df)
    least = {}
    for k, _, h in data:
        if k is not None:
            least[h or ""] = min(least.get(h or "", k), k)
    want = []
    for k, _, h in data:
        raw = (h or "").encode()
        first = least.get(h or "") if len(raw) >= 100 else None
        again = first is not None and first != k
        want.append((k, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    same(warc.read_pages(warc.write_pages(df)).collect(), want)


def test_warc_reader_rejects_damage():
    good = warc.page_record(1, "u", b"payload" * 9, 63, hashlib.sha256(b"payload" * 9).hexdigest(), None)
    assert len(list(warc.read_records(io.BytesIO(good * 3)))) == 3
    wrong = warc.page_record(1, "u", b"payload" * 9, 63, "0" * 64, None)
    for bad in (good + good[:-9], good[:40], wrong):
        with pytest.raises((warc.WarcError, zlib.error)):
            list(warc.read_records(io.BytesIO(bad)))


# 10


def brute_stats(text):
    words = SPACE.findall(text or "")
    where = defaultdict(list)
    for i in range(len(words) - 7):
        where[tuple(words[i : i + 8])].append(i)
    covered = {i + k for v in where.values() if len(v) > 1 for i in v for k in range(8)}
    ls = [x for x in (text or "").split("\n") if SPACE.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(ls) - len(set(ls)), len(covered)


def test_rules(spark, rows, docs):
    extra = rows + [(3000, "a b c d e f g h i " * 3 + "#*$%&|<>! ABC", "", "", 0), (3001, "same\n" * 30, "", "", 0), (3002, "p q\n\n p q\np q\n", "", "", 0)]
    df = spark.createDataFrame(extra, DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = rules.judge(df, labels).select("doc_id", *rules.STATS[:5], "base_failed", "kept").collect()
    want = []
    for r in extra:
        s = brute_stats(r[1])
        failed = s[0] < 20 or 100 * s[4] > 30 * s[0]
        want.append((r[0], *s, failed, not failed))
    same(got, want)
    kept = rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(not (brute_stats(r[1])[0] < 20 or 100 * brute_stats(r[1])[4] > 30 * brute_stats(r[1])[0]) for r in rows)


def test_rules_learn(spark):
    """Learned from the rows outside a held-out fold, judged on the fold."""
    d, labels = (queries.table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    out = rules.judge(d, labels.where(~fold)).join(labels.where(fold), "doc_id").where("not base_failed").collect()
    good, bad = [r["kept"] for r in out if r["quality"] == 1], [r["kept"] for r in out if r["quality"] == 0]
    assert len(good) > 50 and np.mean(good) > 0.97 and np.mean(bad) < 0.3


def brute_features(text):
    n, chars, symbols, dup, repeat = brute_stats(text)
    words, chars = max(n, 1), max(chars, 1)
    upper, marks = (sum(ok(c) for c in text or "") for ok in (lambda c: "A" <= c <= "Z", lambda c: c == "!"))
    return {"n_words": n, "word_length": chars / words if n else 0, "symbol_share": symbols / chars, "dup_lines_per_100_words": 100 * dup / words, "repeat_share": repeat / words, "upper_share": upper / chars, "marks_per_word": marks / words}


def brute_verdict(found, text):
    """Base rule, then the list, evaluated on statistics taken here."""
    f = brute_features(text)
    if f["n_words"] < 20 or 100 * f["repeat_share"] > 30:
        return False
    return not any(all(f[c.feature] > c.threshold if c.above else f[c.feature] <= c.threshold for c in r.conditions) for r in found.rules)


def test_rules_grow_conjunctions(spark):
    """Bad is what has both many symbols and many capitals; either alone is good. Verdicts against an independent evaluation, on rows no label of which was seen."""
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    data, labels = [], []
    for k in range(1200):
        kind, ws = k % 4, [word() for _ in range(rng.randint(25, 60))]
        if kind in (0, 1):
            ws = [w + "#" if rng.random() < 0.5 else w for w in ws]
        if kind in (0, 2):
            ws = [w.upper() if rng.random() < 0.5 else w for w in ws]
        data.append((k, " ".join(ws), "en", "s", 1))
        labels.append((k, int(kind != 0), 0))
    data += [(5000, None, "en", "s", 0), (5001, " ".join(["x y z"] * 30), "en", "s", 0), (5002, "a " * 5, "en", "s", 0)]
    df = spark.createDataFrame(data, DOCS)
    seen = spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, quality int, toxic int")
    stats, column = rules.text_stats(df)
    found = rules.learn_from(stats, column, "doc_id", seen)
    assert max(len(r.conditions) for r in found.rules) >= 2, str(found)
    got = {r["doc_id"]: r["kept"] for r in rules.judge(df, seen).collect()}
    assert got == {r[0]: brute_verdict(found, r[1]) for r in data}
    held = [(got[k], bool(q)) for k, q, _ in labels if k % 3 == 0]
    assert np.mean([a == b for a, b in held]) > 0.95
    same([(k,) for k, v in got.items() if v], [(r["doc_id"],) for r in rules.keep_good(df, seen).collect()])


def test_rules_are_native(spark, sf):
    plan = queries.op10_quality_rules(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@pytest.mark.parametrize("f", [lambda d, s: mixing.mix(d), lambda d, s: mixing.mixed(d), lambda d, s: decontam.contamination(d, s.createDataFrame([], "item_id long, text string")), lambda d, s: tokens.read_digests(tokens.write_tokens(d, queries.vocabulary())), lambda d, s: lines.decisions(d), lambda d, s: lines.deduplicated(d), lambda d, s: substrings.removals(d), lambda d, s: substrings.deduplicated(d), lambda d, s: simhash.near_duplicates(d), lambda d, s: simhash.keep_one(d), lambda d, s: rules.judge(d, s.createDataFrame([], "doc_id long, quality int")), lambda d, s: classifier.classify(d, s.createDataFrame([], "doc_id long, quality int")), lambda d, s: warc.read_pages(warc.write_pages(d.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html")))), lambda d, s: chat.digests(chat.formatted(chat.canonical(s.createDataFrame([], "conv_id long, turn long, role string, text string"))))])
def test_empty_tables(spark, empty, f):
    assert f(empty, spark).collect() == []


def test_whole_texts(spark):
    """A text far longer than a batch goes through whole."""
    long = " ".join(f"w{k}" for k in range(200_000))
    df = spark.createDataFrame([(1, long, "en", "s", 1), (2, "x " + long, "en", "s", 1), (3, "short", "en", "s", 1)], DOCS)
    out = {r["doc_id"]: r for r in substrings.removals(df).collect()}
    assert (out[1]["n_removed"], out[2]["n_removed"]) == (0, 200_000)
    assert {r["doc_id"]: r["size"] for r in mixing.mix(df).collect()} == {1: 200_000, 2: 200_001, 3: 1}
    assert len({r["fp"] for r in simhash.fingerprints(df).collect()}) >= 2
    stats = {r["doc_id"]: tuple(r) for r in rules.judge(df, spark.createDataFrame([], "doc_id long, quality int")).select("doc_id", *rules.STATS[:5]).collect()}
    assert stats == {r[0]: (r[0], *brute_stats(r[1])) for r in ((1, long), (2, "x " + long), (3, "short"))}
    scores = {r["doc_id"]: r["score"] for r in classifier.Model(b"short words of a good kind " * 9, b"### bad ### " * 9, [0.0, -5.0, 1.0]).score(df).collect()}
    assert len(set(scores.values())) == 3
    said = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long + "###")], "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.formatted(chat.canonical(said))).first()
    assert [t["text"] for t in back["turns"]] == [long, long + "###"] and back["loss"] == long + "###"


def test_oracles(spark):
    import duckdb

    folder = "/root/testdata/sf0.01"
    db = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark", "labels"):
        db.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, folder)
        want = db.sql(sql)
        columns = sorted(got.columns)
        assert columns == sorted(want.columns), name
        same(got.select(*columns).collect(), want.select(*columns).fetchall())
