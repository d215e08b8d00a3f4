"""Each operator against brute force on small tables that hold nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from namelens.llm import chat_format, fingerprints, ngram_join, packing, quality_rules, source_mixing, substring_dedup, toxicity
from namelens.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCAB = [f"w{i}" for i in range(40)] + ["é", "ЖЖ", "a b", "!!", "x#y"]


def corpus() -> list[tuple]:
    """Random texts, copies, near copies, shared passages; null, empty, blank, short and very long ones; a repeated row."""
    rng = random.Random(7)
    words = lambda n: [rng.choice(VOCAB) for _ in range(n)]
    texts = [" ".join(words(rng.randint(1, 120))) for _ in range(60)]
    shared = " ".join(words(40))
    texts += [" ".join(words(5)) + "\n" + shared + "\t" + " ".join(words(9)) for _ in range(8)]
    base = words(150)
    for k in range(10):
        w = list(base)
        for i in rng.sample(range(150), k // 2):
            w[i] = f"new{k}.{i}"
        texts.append(" ".join(w))
    texts += [texts[3]] * 3 + [None, "", " \t\n", "one", "one two", "é" * 50, " ".join(words(6000)), "la la la " * 40, "line\nline\nline\n\nother"]
    rows = [(i * 3, t, "en", [f"s{i % 4}", None][i % 9 == 0], len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[5]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


def split(t):
    return (t or "").encode().split()


def test_statistics_and_base_rule(docs):
    got = {r["doc_id"]: r for r in quality_rules.statistics(docs).withColumn("base_failed", quality_rules.base_failed()).collect()}
    for i, t, *_ in corpus():
        w = split(t)
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        n, covered = collections.Counter(grams), set()
        for k, g in enumerate(grams):
            if n[g] > 1:
                covered |= set(range(k, k + 5))
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        want = (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))


def test_decision_list_by_hand(spark):
    """The rules' counts and the verdicts of all rows, worked out in Python from the statistics."""
    rng = random.Random(11)
    rows = []
    for i in range(600):
        kind = i % 5
        w = [rng.choice("abcdefgh") * (9 if kind == 0 else 4) + str(rng.randrange(4 if kind == 1 else 1000)) for _ in range(rng.randint(12, 60))]
        rows.append((i, " ".join(w), "en", "s", 1))
    d = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 5 > 1)) for i in range(0, 600, 2)], "doc_id long, quality int")
    sample = quality_rules.labelled_statistics(d, labels).filter(~quality_rules.base_failed())
    rules = quality_rules.learn(sample)
    assert len(rules) >= 2
    values = lambda df: [r.asDict() for r in df.select("*", *[c.alias("f_" + k) for k, c in quality_rules.features().items()]).collect()]
    holds = lambda r, x: all((x["f_" + c.feature] > c.threshold) == c.above for c in r.conditions)
    apart = {r[0] for r in sample.filter(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).select("doc_id").collect()}
    left = [x for x in values(sample) if x["doc_id"] in apart]
    for r in rules:
        hit = [x for x in left if holds(r, x)]
        assert (r.bad, r.good) == (sum(not x["good"] for x in hit), sum(x["good"] for x in hit)) and r.bad >= 0.97 * (r.bad + r.good)
        left = [x for x in left if not holds(r, x)]
    for x in values(quality_rules.quality_rules(d, labels)):
        assert x["kept"] == (not x["base_failed"] and not any(holds(r, x) for r in rules))


def test_decision_list_learns_and_keeps_columns(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        junk = i % 4 == 0
        w = [rng.choice(VOCAB[:40]) + str(rng.randint(0, 99)) + ("###" if junk else "") for _ in range(60)]
        rows.append((i, " ".join(w), "en", "s", 1, "extra"))
    d = spark.createDataFrame(rows, SCHEMA + ", __row string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(0, 400)], "doc_id long, quality int")
    kept = quality_rules.kept_documents(d, labels)
    assert kept.columns == d.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i in range(400) if i % 4}
    none = quality_rules.quality_rules(d, labels.limit(0))
    assert none.filter("kept").count() == 400
    assert quality_rules.quality_rules(d.limit(0), labels).count() == 0


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_ngram_join_finds_all_links(docs, k, percent):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = {}
    for i, t, *_ in corpus():
        w = (t or "").encode().translate(low).split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    least = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and sets[b]]
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            if (least[a], least[b]) != (m, m):
                least[a] = least[b] = m
                changed = True
    got = ngram_join.near_duplicates(docs, k=k, percent=percent).collect()
    assert len(got) == len(corpus())
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(sets[i]), least[i]) for i in sets}
    assert ngram_join.near_duplicates(docs.limit(0), k=k, percent=percent).count() == 0


def covered_words(texts, window=13):
    first = {}
    for i, t in texts:
        w = split(t)
        for s in range(len(w) - window + 1):
            g = tuple(w[s : s + window])
            first[g] = min(i, first.get(g, i))
    return {i: {x for w in [split(t)] for s in range(len(w) - window + 1) if first[tuple(w[s : s + window])] < i for x in range(s, s + window)} for i, t in texts}


@pytest.mark.parametrize("max_shard", [5000, 1])
def test_substring_dedup(docs, max_shard):
    texts = [(r[0], r[1]) for r in corpus()]
    gone = covered_words(texts)
    assert sum(map(len, gone.values())) > 500
    got = {r["doc_id"]: r for r in substring_dedup.removed_digests(docs, max_shard=max_shard).collect()}
    for i, t in texts:
        w = split(t)
        stay = b" ".join(x for k, x in enumerate(w) if k not in gone[i])
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), len(gone[i]), hashlib.sha256(stay).hexdigest())
    assert substring_dedup.removed_digests(docs.limit(0)).count() == 0


def test_suffix_automaton_matches_brute_force():
    rng = random.Random(3)
    for _ in range(40):
        seqs = [[rng.randint(0, 2) for _ in range(rng.randint(0, 12))] for _ in range(3)]
        q = [rng.randint(0, 2) for _ in range(15)]
        a = substring_dedup.SuffixAutomaton()
        for s in seqs:
            a.add(s)
        known = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        want = [max([n for n in range(1, e + 2) if tuple(q[e + 1 - n : e + 1]) in known], default=0) for e in range(len(q))]
        assert a.matching_statistics(q) == want


def test_mixing_reaches_targets(docs):
    got = source_mixing.taken_words(docs).collect()
    again = source_mixing.taken_words(docs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) == len(corpus())
    by = collections.defaultdict(int)
    for r in got:
        assert r["taken"] <= 2 * r["size"]
        by[r["target"], r["source_size"]] += r["taken"]
    for (target, _), n in by.items():
        assert abs(n - target) <= max(20, 0.02 * target)
    mixed = source_mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(split(r["text"])) for r in mixed.collect()) == sum(r["taken"] for r in got)
    assert source_mixing.taken_words(docs.limit(0)).count() == 0


def test_water_fill():
    shares = source_mixing.water_fill([("a", 10), ("b", 1000), ("c", 1000)], [5, 2, 1], 1.5 * 2010, 2)
    assert [round(x.target, 6) for x in shares] == [20, 1996.666667, 998.333333]


def test_packing_is_whole_and_tight(docs):
    got = packing.pack(docs, tokenizer_path()).toPandas()
    encode = packing.encoder(tokenizer_path())
    for i, t, *_ in corpus():
        ids, rows = np.array([*encode(t or ""), 0], "<u4"), got[got.doc_id == i].drop_duplicates("piece").sort_values("piece")
        assert rows.start.tolist() == np.r_[0, np.cumsum(rows.length)][:-1].tolist() and rows.length.sum() == len(ids)
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(rows.start, rows.length, strict=True)] == rows.ids_crc32.tolist()
    for _, x in got.sort_values("offset").groupby("sequence_id"):
        assert x.offset.tolist() == np.r_[0, np.cumsum(x.length)][:-1].tolist() and x.length.sum() <= 2048
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1
    assert packing.pack(docs.limit(0), tokenizer_path()).count() == 0


def test_encoder_has_the_tokenizers_ids():
    from tokenizers import Tokenizer

    slow, encode = Tokenizer.from_file(tokenizer_path()), packing.encoder(tokenizer_path())
    for t in ["", "a <|endoftext|> b", "don't  stop\n\n\tnow ", "naïve Ж 汉字 🙂", *[r[1] or "" for r in corpus()]]:
        assert encode(t) == slow.encode(t, add_special_tokens=False).ids


def test_chats_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "", None, " \\ \\\\ <\\s> 汉字🙂 ", "x" * 5000, "<|endoftext|>"]
    rows = [(c, t, ["user", "assistant", "system", None][(c + t) % 4], odd[(c * 5 + t) % len(odd)], "x") for c in range(8) for t in range(c + 1)] + [(None, 0, "assistant", "a", "x")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r["conv_id"]: r for r in chat_format.digests(chat_format.format_chats(d, tokenizer_path())).collect()}
    for c in [*range(8), None]:
        turns = [(r or "", t or "") for k, _, r, t, _ in sorted((x for x in rows if x[0] == c), key=lambda x: x[1])]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    assert chat_format.format_chats(d.limit(0), tokenizer_path()).count() == 0


def test_fingerprints(docs):
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(docs).collect()}
    rows = sorted({(i, t or "") for i, t, *_ in corpus()})
    same = collections.defaultdict(set)
    for k, (i, t) in enumerate(rows):
        if i == corpus()[-1][0]:
            continue  # a repeated row is its own next
        after = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
        same[t].add(got[i]["fingerprint"])
    assert all(len(v) == 1 for v in same.values())
    assert fingerprints.edited_fingerprints(docs.limit(0)).count() == 0


def test_segments_against_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        # no two sums are equal, so that the segments are unique
        s = [rng.uniform(0.5, 4) if rng.random() < 0.4 else -1.0 for _ in range(12)]
        at = [i for i, v in enumerate(s) if v > 0]
        got = toxicity.segments(at, [s[i] for i in at], -1.0)

        def best(lo, hi):
            """Maximal segments by definition: the best one, then those of both sides."""
            c = [(sum(s[a:b]), -(b - a), a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)]
            if not c or max(c)[0] <= 0:
                return []
            v, _, a, b = max(c)
            return [*best(lo, a), (a, b - 1, v), *best(b, hi)]

        assert [(a, b, round(v, 9)) for a, b, v in got] == [(a, b, round(v, 9)) for a, b, v in best(0, 12)]


def test_toxicity_learns(spark):
    rng = random.Random(2)
    rows = []
    for i in range(600):
        w = [f"{rng.choice('abcdefgh')}{rng.choice('klmnop')}{rng.randint(0, 30)}x" for _ in range(80)]
        w = [x.translate(str.maketrans("0123456789", "abcdefghij")) for x in w]
        if i % 5 == 0:
            for _ in range(4):
                w[rng.randint(0, 79)] = rng.choice(["vilezz", "nastyqq", "gruntyy"])
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame([*rows, (600, None), (601, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.score(d, toxicity.train(d, labels)).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()}
    held = [i for i in range(600) if out[i]["held"]]
    assert len(held) > 80 and all(out[i]["held"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(600))
    assert sum((out[i]["score"] >= 0.3) == (i % 5 == 0) for i in held) >= 0.95 * len(held)
    assert out[600]["score"] == out[601]["score"] < 0.3
    assert toxicity.score(d, toxicity.train(d, labels.limit(0))).filter("score > 0").count() == 0


def test_substring_dedup_keeps_all_columns(spark):
    """Columns named like the new ones or like inner ones, null and shared ids, repeated rows."""
    text = " ".join(f"a{i}" for i in range(30))
    rows = [(1, text, 7, "x", "y"), (2, "pre " + text, 8, None, "y"), (2, "other " + text, 9, "z", None), (None, "zz " + text, 1, "n", "n"), (None, None, 2, "n", "n"), (1, text, 7, "x", "y")]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_words int, __doc string, spans string")
    out = substring_dedup.remove_repeats(d)
    assert out.columns == [*d.columns, "_n_words", "n_removed", "kept_text"]
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    want = [(*rows[0], 30, 30, ""), (*rows[1], 31, 30, "pre"), (*rows[2], 31, 30, "other"), (*rows[3], 31, 0, "zz " + text), (*rows[4], 0, 0, ""), (*rows[5], 30, 30, "")]
    assert got == sorted(want, key=repr)
    assert substring_dedup.remove_repeats(d.limit(0)).count() == 0
