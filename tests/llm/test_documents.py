"""Near duplicates, repeated passages, language, quality and scores against brute force."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import lower
from pyspark.sql import functions as F

from tessella.llm import ctw, jaccard, language, quality, suffixes
from tessella.llm.common import crc_mod, each_once, hash_strings, strings, text_hash, words_of
from tessella.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def linked_brute(rows):
    sets, inverse, parent = [], collections.defaultdict(list), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, (_, t) in enumerate(rows):
        w = WORD.findall(lower(t or ""))
        s = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        count = collections.Counter(j for x in s for j in inverse[x])
        for j, both in count.items():
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
        for x in s:
            inverse[x].append(i)
        sets.append(s)
    groups = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    return {d: (len(sets[i]), min(groups[find(i)])) for i, (d, _) in enumerate(rows)}


def near_rows(seed=5):
    rng, rows = random.Random(seed), []
    for _ in range(45):
        n = rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 50, 120, 400])
        w = [f"w{rng.randrange(3000)}" for _ in range(n)]
        for _ in range(rng.choice([1, 2, 3, 5, 30])):
            x = list(w)
            for _ in range(rng.randrange(0, 1 + max(1, n // 25))):
                k = rng.random()
                if k < 0.4:
                    x[rng.randrange(len(x))] = f"W{rng.randrange(3000)}"
                elif k < 0.7:
                    x.insert(rng.randrange(len(x) + 1), f"w{rng.randrange(3000)}")
                elif len(x) > 1:
                    del x[rng.randrange(len(x))]
            rows.append((len(rows) * 3 + 1, " ".join(x)))
    passage = [f"p{i}" for i in range(60)]
    other = lambda: [f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 80))]
    rows += [(200000 + i, " ".join(other() + passage + other())) for i in range(120)]
    rows += [(100000, None), (100001, ""), (100002, " \n"), (100003, None)]
    rng.shuffle(rows)
    return rows


def test_near_duplicates(spark):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = linked_brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked(df).collect()} == want
    kept = sorted(r.doc_id for r in jaccard.one_of_each(df).collect())
    assert kept == sorted(d for d, (n, c) in want.items() if n == 0 or d == c)


def test_pigeonhole_loses_nothing():
    """Every linked pair shares a key, in the right roles, and its sketches leave room."""
    rng = random.Random(8)
    for _ in range(300):
        n = rng.choice([1, 2, 3, 4, 5, 7, 10, 20, 60, 300])
        a = {rng.getrandbits(64) for _ in range(n)}
        b = set(a)
        for _ in range(rng.randrange(0, max(1, n // 3) + 1)):
            if rng.random() < 0.5 and len(b) > 1:
                b.discard(rng.choice(sorted(b)))
            else:
                b.add(rng.getrandbits(64))
        both = len(a & b)
        if 100 * both < 75 * len(a | b):
            continue
        x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
        (fx, ex), (fy, ey) = jaccard.signatures(x), jaccard.signatures(y)
        key = lambda f, role: {int(k) for ks, r in f for k in ks if r & role}
        if ex and ey:
            assert key(fx, 1) & key(fy, 2) or key(fx, 2) & key(fy, 1)
        sx, sy = jaccard._sketch(x), jaccard._sketch(y)
        w = min(len(sx), len(sy)) // 8
        assert np.bitwise_count(jaccard._folded(np.frombuffer(sx, "<u8"), w) ^ jaccard._folded(np.frombuffer(sy, "<u8"), w)).sum() <= (len(a) + len(b)) // 7


def test_linked_sets_share_more_keys_than_slack():
    """A set may leave out as many of its keys as it has slack: of those it asks for, linked sets share more."""
    rng, seen = random.Random(9), 0
    for _ in range(400):
        n = rng.choice([5, 10, 20, 60, 150, 400, 1200])
        a = {rng.getrandbits(64) for _ in range(n)}
        b = set(rng.sample(sorted(a), n - rng.randrange(n // 7 + 1)))
        b |= {rng.getrandbits(64) for _ in range(rng.randrange(n // 6 + 1))}
        if 100 * len(a & b) < 75 * len(a | b):
            continue
        x, y = (np.array(sorted(s), np.uint64) for s in sorted((a, b), key=len))
        (fx, enough), (fy, _) = jaccard.signatures(x), jaccard.signatures(y)
        next_ = int(np.searchsorted(jaccard.EDGES, len(y), side="right") - np.searchsorted(jaccard.EDGES, len(x), side="right"))
        asked = {int(k) for ks, r in fx if r & jaccard.PROBE and bool(r & jaccard.NEXT) == bool(next_) for k in ks}
        has = {int(k) for ks, r in fy if r & jaccard.INDEX for k in ks}
        if enough:
            assert len(asked & has) > jaccard.slack(x)[next_]
            seen += jaccard.slack(x)[next_] > 0
    assert seen > 100


def test_keys_are_dealt_by_band():
    """A set's keys go to the reducers of its two bands, not to all: its name is sent to few. Parts are even, and equal keys are in one part."""
    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(int(2 ** rng.uniform(5, 11)))) for _ in range(400)]
    n, _ = jaccard._class(sets := jaccard.shingle_sets(pa.array(texts, pa.large_string())))
    band = np.searchsorted(jaccard.EDGES, n, side="right") - 1
    weights = jaccard.band_keys([(int(b), int((band == b).sum()), int(n[band == b].sum())) for b in np.unique(band)])
    rows = [r for b in jaccard._emit(weights, 100)(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])])) for r in b.to_pylist()]
    sizes, where, sent = collections.Counter(), {}, 0
    for r in rows:
        keys = jaccard._unplanes(r["keys"], 6)
        sizes[r["p"]] += len(keys)
        sent += len(r["names"]) // 8
        assert all(where.setdefault(k, r["p"]) == r["p"] for k in keys.tolist())
    emitted = [{int(k) & (1 << 48) - 1 for keys, _ in jaccard.signatures(s)[0] for k in keys} for s in sets]
    assert set(where) == set().union(*emitted)
    assert max(sizes) < 100 and max(sizes.values()) < 1.5 * sum(sizes.values()) / 100
    dealt_evenly = sum(len({k * 100 >> 48 for k in x}) for x in emitted)  # by the keys alone, as before
    assert sent < 0.4 * dealt_evenly, (sent, dealt_evenly)


def test_common_passages_bring_no_comparisons(spark, monkeypatch):
    """Texts that have a passage in common, and else nothing, stay out of the comparisons by sketches; their near copies are found."""
    counts, written = collections.Counter(), jaccard.written

    def counted(df, name):
        out = written(df, name)
        counts[name] += out.count()
        return out

    monkeypatch.setattr(jaccard, "written", counted)
    rng = random.Random(2)
    passage = [f"p{i}" for i in range(11)]
    rows = [(i, " ".join([f"q{rng.randrange(10**6)}" for _ in range(120)] + passage)) for i in range(400)]
    rows += [(1000 + i, t + " more words") for i, t in rows[:40]]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == linked_brute(rows) and got[1000] == (129, 0)
    assert counts["met"] > 40 and counts["runs"] < 100


def test_grid_of_a_run(spark):
    """Each probe meets each other set of its run in one block, and a run of few probes is not copied by the square of its length."""
    rows = [(1, i, jaccard.INDEX | (jaccard.PROBE if i < 3 else 0), 1, 7) for i in range(200)] + [(2, i, 1 + i % 3, 3, 4) for i in range(60)]
    dealt = jaccard._grid(spark.createDataFrame(rows, "run long, name long, role int, down int, across int")).collect()
    met = collections.Counter()
    for p in dealt:
        met.update((p.run, p.name, q.name) for q in dealt if p.role & jaccard.PROBE and q.role & jaccard.INDEX and (p.run, p.block) == (q.run, q.block))
    assert met == collections.Counter((p[0], p[1], q[1]) for p in rows for q in rows if p[0] == q[0] and p[2] & jaccard.PROBE and q[2] & jaccard.INDEX)
    assert sum(r.run == 1 for r in dealt) <= 200 + 3 * 7


def test_join_on_all_hashes(spark):
    rows = near_rows(7)[:150]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = jaccard.shingle_sets(pa.array([t or "" for _, t in rows], pa.large_string()))
    n, names = jaccard._class(sets)
    rest = spark.createDataFrame([(int(x),) for x in set(names[n > 0].tolist())], "name long")
    own = df.select("text").mapInArrow(jaccard._all_hashes, "name long, n long, h long").distinct()
    got = {(r.a, r.b) for r in jaccard._rest(own, rest).collect()}
    by = {int(x): set(s.tolist()) for x, s in zip(names, sets) if len(s)}
    assert got >= {(a, b) for a in by for b in by if a < b and 100 * len(by[a] & by[b]) >= 75 * len(by[a] | by[b])}
    assert all(a < b and by[a] & by[b] for a, b in got)


def test_a_text_goes_to_one_bucket(spark, monkeypatch):
    """Near copies bring pairs by the square, but each text of a group goes to one bucket; a large group is cut, and only its pivot goes to many."""
    monkeypatch.setattr(jaccard, "ENTRIES", 200)
    groups = [(20 * g + i, 20 * g + j) for g in range(30) for i in range(12) for j in range(i + 1, 12)]
    star = [(1000, 1001 + i) for i in range(300)]
    names = sorted({x for p in groups + star for x in p})
    sizes = spark.createDataFrame([(x, 10) for x in names], "name long, n long")
    rows = [(r.bucket, r.a, r.b) for r in jaccard._in_buckets(spark.createDataFrame(groups + star, "a long, b long"), sizes).collect()]
    assert sorted(r[1:] for r in rows) == groups + star
    where = collections.defaultdict(set)
    for bucket, a, b in rows:
        where[a].add(bucket)
        where[b].add(bucket)
    assert all(len(where[x]) == 1 for x in names if x != 1000) and len(where[1000]) > 8
    most = max(collections.Counter(x for b in where.values() for x in b).values())
    assert most < 100  # not a whole star: 1,000 hashes


def test_pairs_of_a_bucket():
    """Pairs that link, whatever the order of texts; copies of a text count once."""
    base = [f"w{i}" for i in range(40)]
    texts = {7: base, 3: [*base, "x"], 9: base[:20] + ["y"] * 20, 5: base[1:]}
    table = pa.table({"bucket": pa.array([0] * 5), "name": pa.array([7, 3, 9, 5, 7]), "text": [" ".join(texts[x]) for x in (7, 3, 9, 5, 7)]})
    pairs = pa.table({"bucket": pa.array([0] * 4), "a": pa.array([3, 7, 5, 3]), "b": pa.array([7, 9, 7, 5])})
    assert jaccard._verified(table, pairs).to_pylist() == [{"a": 3, "b": 7}, {"a": 5, "b": 7}, {"a": 3, "b": 5}]


def test_few_keys(spark):
    """Reducers get keys of some classes only."""
    rows = [(3, "one"), (1, "One"), (2, "a b c d e f")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == linked_brute(rows)


def test_sets_short_of_keys_send_few_hashes(spark, monkeypatch):
    """A set whose allocations fall short is looked for in all texts, but the hashes of the others are not shuffled."""
    counts, written = collections.Counter(), jaccard.written

    def counted(df, name):
        out = written(df, name)
        counts[name] += out.count()
        return out

    monkeypatch.setattr(jaccard, "written", counted)
    monkeypatch.setattr(jaccard, "ENTRIES", 5)  # more hashes than one pass looks for
    rng = random.Random(3)
    short = lambda t: not jaccard.signatures(jaccard.shingle_sets(pa.array([t], pa.large_string()))[0])[1]
    text = next(t for t in (" ".join(f"w{rng.randrange(10**6)}" for _ in range(11)) for _ in range(10**5)) if short(t))
    rows = [(1, text), (2, text + " more"), (3, f"{text} other"), (4, text.upper()), (5, " ".join(text.split()[:9]) + " else"), (6, text)]
    rows += [(10 + i, " ".join(f"v{rng.randrange(10**6)}" for _ in range(rng.choice([11, 12])))) for i in range(30)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == linked_brute(rows) and got[3] == (8, 1)
    assert 7 <= counts["sets"] < 60


@pytest.mark.parametrize("wide", [16_384, 20])
def test_near_copies_of_one_text(spark, monkeypatch, wide):
    """A large group whose members link with few others, and whose links no pivot gives; exact copies; whole runs and runs in blocks."""
    monkeypatch.setattr(jaccard, "WIDE", wide)
    monkeypatch.setattr(jaccard, "ENTRIES", 1_000_000 if wide > 20 else 3000)
    rng = random.Random(8)
    base = [f"w{rng.randrange(500)}" for _ in range(100)]
    rows = []
    for i in range(250):
        x = list(base)
        for _ in range(rng.randrange(1, 5)):
            x[rng.randrange(100)] = f"v{i}"
        rows.append((1000 - i, " ".join(x)))
    rows += [(2000 + i, rows[5][1]) for i in range(30)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = linked_brute(rows)
    assert got == want and 1 < len({c for _, c in want.values()}) < 250


def test_star_links():
    """At most one link fewer than members, and what they join is what all links join."""
    rng = random.Random(4)
    sets = [np.array(sorted(rng.sample(range(30 * (i % 4), 30 * (i % 4) + 30), rng.randrange(23, 29))), np.uint64) for i in range(60)]
    group = pa.table({"name": pa.array(range(60)), "component": pa.array(range(60)), "hashes": pa.array([s.tobytes() for s in sets], pa.binary())})
    found = jaccard._star(group).to_pylist()
    true = {(i, j) for i in range(60) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}

    def parts(pairs):
        own = list(range(60))
        for i, j in pairs:
            own = [min(own[i], own[j]) if x in (own[i], own[j]) else x for x in own]
        return own

    assert {(r["b"], r["a"]) for r in found} <= true and len(true) > len(found) > 5 and parts((r["a"], r["b"]) for r in found) == parts(true)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    assert {r.node: r.component for r in components(df).collect()} == {x: find(x) for x in parent}
    assert components(df.where("false")).collect() == []


def passage_rows():
    rng = random.Random(9)
    some = lambda n: " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randrange(1, 9))) for _ in range(n))
    passages = [some(n) for n in (60, 75, 80, 90, 120, 200, 300, 71, 72)]
    rows = []
    for i in range(90):
        x = []
        for _ in range(rng.randrange(1, 5)):
            x.append(some(rng.randrange(0, 120)))
            if rng.random() < 0.6:
                p = rng.choice(passages)
                x.append(p[rng.randrange(0, len(p) // 3) : len(p) - rng.randrange(0, len(p) // 3)] if rng.random() < 0.5 else p)
        rows.append((i, rng.choice(["", " ", "\n"]).join(x)))
    return rows + [(200, None), (201, ""), (202, "a" * 400), (203, "a" * 401), (204, "b" * 1000), (205, "xy" * 700), (206, "c" * 399), (207, rows[3][1]), (208, rows[3][1]), (209, rows[4][1] + "z"), (210, some(30) + "d" * 500), (211, "d" * 450), (212, ("q" * 37 + "r") * 40)]


def test_repeated_passages(spark):
    rows = passage_rows()
    count = collections.Counter(b[i : i + 400] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - 399))
    want, left = {}, {}
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 399):
            if count[b[i : i + 400]] > 1:
                gone[i : i + 400] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[d] = (len(b), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()), hashlib.sha256(kept).hexdigest())
        left[d] = None if t is None else kept.decode("utf-8", "ignore")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: tuple(r)[1:] for r in suffixes.removed(df).collect()} == want
    assert {r.doc_id: r.text for r in suffixes.without_repeats(df).collect()} == left


def test_language(spark, odd, none):
    rng = random.Random(4)
    syllables = {"aa": ["tha", "ing", "er", "st"], "bb": ["éau", "le", "oui", "ç"], "cc": ["ция", "ов", "при"]}
    say = lambda x, n: " ".join("".join(rng.choice(syllables[x]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, say(x, rng.randrange(3, 60)), x) for i in range(300) for x in [rng.choice("abc") * 2]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df.where("doc_id < 200"), id="doc_id", text="text", lang="lang")
    got = {r.doc_id: r for r in language.languages(df, model).collect()}
    assert sum(got[d].lang_pred == x for d, _, x in rows if d >= 200) >= 98
    mixed = spark.createDataFrame([(1, say("aa", 30) + " 123 " + say("cc", 20)), (2, "12 !!"), (3, None), (4, "")], "doc_id long, text string")
    out = {r.doc_id: r for r in language.languages(mixed, model, spans=True).collect()}
    assert [s.lang for s in out[1].spans] == ["aa", "cc"] and 29 <= out[1].spans[0].end <= 32
    assert all(out[d].lang_pred == "und" and out[d].score == 0 for d in (2, 3, 4))
    assert len(language.languages(odd, model).collect()) == odd.count() and language.languages(none, model).collect() == []
    nothing = language.fit(df.where("false"), id="doc_id", text="text", lang="lang")
    assert {r.lang_pred for r in language.languages(mixed, nothing).collect()} == {"und"}


def test_spans_run_over_any_length():
    """The penalty counts at every word of a text, however long: one odd word in 40,000 switches nothing wherever it stands."""
    scores, n = np.zeros((2, 2)), 40_000
    scores[0, 1], scores[1, 0] = -20, -14.0  # two odd words together would switch, one doesn't
    for odd_at in (32_767, 32_768, 5):
        index = np.zeros(n, np.int64)
        index[odd_at] = 1
        assert not language.viterbi(scores, np.array([0, n]), 15.0, index).any()
    index[20_000:20_010] = 1
    assert np.flatnonzero(language.viterbi(scores, np.array([0, n]), 15.0, index)).tolist() == list(range(20_000, 20_010))


def test_marks_alone_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "one two three", "en"), (2, "uno dos tres", "es")], "doc_id long, text string, lang string")
    odd_ = spark.createDataFrame([(1, "\u0301\u0308 \u0301"), (2, "12 34"), (3, "e\u0301 one")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.languages(odd_, language.fit(docs, id="doc_id", text="text", lang="lang")).collect()}
    assert got[1] == got[2] == ("und", 0.0) and got[3][0] != "und"


def test_many_labels(spark):
    """The most frequent labels are learnt, rarer ones never predicted; a model of many languages stays small."""
    rows = [(i, f"word{i % 200} of label", f"l{i % 200:03d}") for i in range(600)] + [(9000, "rare", "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, logs, _ = language.fit(df, id="doc_id", text="text", lang="lang", max_languages=200)
    assert langs == [f"l{i:03d}" for i in range(200)] and logs.nbytes <= 64 << 20 and len(logs) == (language.BUCKETS >> 2) + 1
    assert len(language.languages(df, (langs, logs, np.ones((200, len(language.SCRIPTS)), bool))).collect()) == 601


def test_predictions_by_brute_force(spark):
    """lang_pred and score from scores of single words, the best of all label sequences, and shares of letters."""
    rng = random.Random(12)
    say = lambda x: "".join(rng.choice({"aa": ["tha", "ing"], "bb": ["éau", "lle"], "cc": ["ция", "ов"]}[x]) for _ in range(2))
    train = spark.createDataFrame([(i, " ".join(say(x) for _ in range(30)), x) for i in range(90) for x in [("aa", "bb", "cc")[i % 3]]], "doc_id long, text string, lang string")
    langs, logs, writes = model = language.fit(train, id="doc_id", text="text", lang="lang")
    texts = [" ".join(say(rng.choice(["aa", "bb", "cc"])) if rng.random() < 0.8 else "12" for _ in range(rng.randrange(1, 7))) for _ in range(40)]
    got = {r.doc_id: r for r in language.languages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        words = t.split()
        score, _ = language.word_scores(pa.array(words, pa.large_string()), logs, writes)
        value = lambda p: sum(score[k, x] for k, x in enumerate(p)) - language.PENALTY * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
        best = max(np.ndindex(*[3] * len(words)), key=value)
        letters = collections.Counter()
        for w, x in zip(words, best):
            letters[x] += sum(ch.isalpha() for ch in w)
        total = sum(letters.values())
        top = min(letters, key=lambda x: (-letters[x], x)) if total else None
        assert got[i].lang_pred == (langs[top] if total else "und") and abs(got[i].score - (letters[top] / total if total else 0)) < 1e-12


def test_ratio_by_brute_force(spark):
    """The model's counts, weights and verdicts of quality, from hashes of tokens and pairs that Spark gives and plain counting."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["good", "fine", "day!", "bad", "x1_y", "??"]) for _ in range(rng.randrange(0, 40))) for _ in range(60)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    trusted = df.where("doc_id % 3 = 0").select("doc_id")
    weights = quality.fit(df, trusted, prior=50.0)
    token = re.compile(r"\w+|[^\w\s]+")
    words = sorted({w for t in texts for w in token.findall(t or "")})
    one = {r.w: r.h for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    pairs = {(r.a, r.b): r.h for r in spark.createDataFrame([(a, b) for a in one.values() for b in one.values()], "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()}

    def buckets(t):
        h = [one[w] for w in token.findall(t or "")]
        return [x % quality.BUCKETS for x in h] + [pairs[x] % quality.BUCKETS + quality.BUCKETS for x in zip(h, h[1:])]

    raw, good = collections.Counter(), collections.Counter()
    for i, t in enumerate(texts):
        raw.update(buckets(t))
        good.update(buckets(t) if i % 3 == 0 else [])
    for half in (0, 1):
        n, m = (sum(v for b, v in c.items() if b // quality.BUCKETS == half) for c in (raw, good))
        for b in (b for b in raw if b // quality.BUCKETS == half):
            p = raw[b] / n
            assert abs(weights[b] - math.log((good[b] + 50.0 * p) / (m + 50.0) / p)) < 1e-12
    for r in quality.judged(df, weights).collect():
        b = buckets(texts[r.doc_id])
        llr = sum(weights[x] for x in b) / max(1, len(b))
        assert abs(r.llr - llr) < 1e-8 and r.kept == (not r.base_failed and r.llr >= quality.THRESHOLD)


def test_stages_with_clashing_names(spark):
    """Columns named like an operator's own come through near duplicates and repeated passages as they are."""
    own = "name long, mark int, _name_ int, _hit_ int, _cut_ string, _fixed_ int, hash int, cut int, kept int, own int, component_id int, NODE int"
    rows = [(d, t, *[None if i % 3 else i for i in range(12)]) for d, t in passage_rows()]
    rows = [r[:6] + (None if r[6] is None else str(r[6]),) + r[7:] for r in rows]
    df = spark.createDataFrame([*rows, rows[-1], rows[-1]], f"doc_id long, text string, {own}")
    one = jaccard.one_of_each(df)
    assert one.columns == df.columns and one.count() < df.count()
    assert len(one.where("doc_id = 212").collect()) == 1  # whole rows that repeat leave one
    out = suffixes.without_repeats(df)
    assert out.columns == df.columns and out.count() == df.count() and [f.dataType for f in out.schema] == [f.dataType for f in df.schema]


def test_copies_of_a_text_send_their_keys_once(spark):
    rows = [(i, "some words of a text that has many copies " * 30) for i in range(40)] + [(100, "another text"), (101, None), (102, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = df.select(text_hash(F.col("text")).alias("hash"))
    got = sorted(r.text or "" for r in each_once(df, "text", hashes).collect())
    assert len(got) == 4 and got[:2] == ["", ""]


def test_corpus_order_by_brute_force():
    """Strings over a trigger that repeat inside a group, from suffix arrays of what stands before and after it."""
    rng = random.Random(6)
    for length in (3, 6, 9):
        rows = [(rng.randrange(2), "".join(rng.choice("ab") for _ in range(rng.randrange(0, length))), "".join(rng.choice("ab") for _ in range(length))) for _ in range(40)]
        group = np.array([g for g, _, _ in rows])
        before = np.array([len(p) for _, p, _ in rows])
        pad = lambda x: np.array([[ord(c) for c in t.ljust(length, "\0")] for t in x], np.uint8)
        least = np.minimum(before, np.array([rng.randrange(0, 2) for _ in rows]))
        row, d = suffixes.corpus_order(group, pad([p[::-1] for _, p, _ in rows]), pad([t for _, _, t in rows]), least, before, length)
        strings_ = collections.defaultdict(list)
        for i, (g, p, t) in enumerate(rows):
            for k in range(least[i], before[i] + 1):
                strings_[g, k, p[len(p) - k :] + t[: length - k]].append((i, k))
        assert sorted(zip(row.tolist(), d.tolist())) == sorted(x for v in strings_.values() if len(v) > 1 for x in v)


def test_viterbi():
    rng = np.random.default_rng(6)
    for _ in range(30):
        n, k, penalty = int(rng.integers(1, 7)), 3, 1.0
        s = -rng.random((n, k)) * 3
        best = max(np.ndindex(*[k] * n), key=lambda p: sum(s[i, x] for i, x in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:])))
        got = language.viterbi(np.concatenate([s, s]), np.array([0, n, n, 2 * n]), penalty)
        assert tuple(got[:n]) == best and tuple(got[n:]) == best


def test_quality(spark, odd, none):
    rng = random.Random(4)
    clean = lambda n: " ".join(rng.choice(["the", "of", "house", "tree", "and", "river"]) for _ in range(n))
    rows = [(i, clean(60) if i % 4 else " ".join(w + "$$$" for w in clean(60).split())) for i in range(200)]
    rows += [(500, None), (501, ""), (502, clean(5)), (503, " ".join(["a b c d e f g h"] * 6)), (504, "x y\nx y\n \n \nx y"), (505, "w " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    weights = quality.fit(df, df.where("doc_id % 4 <> 0 AND doc_id < 100").select("doc_id"))
    got = {r.doc_id: r for r in quality.judged(df, weights).collect()}
    for d, t in rows:
        w = WORD.findall(t or "")
        count = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum((t or "").count(x) for x in "#*$%&|<>"), dup, len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
    assert all(got[i].kept == bool(i % 4) for i in range(200))
    assert len(quality.judged(odd, weights).collect()) == odd.count() and quality.judged(none, weights).collect() == []
    assert set(quality.fit(df, df.where("false").select("doc_id"))) == {0.0}


def test_quality_stays_in_spark(spark, odd):
    plan = quality.judged(odd, [0.0] * (2 * quality.BUCKETS))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@pytest.mark.parametrize("head", [1 << 20, 4])
def test_scores(spark, odd, none, head):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the", "The", "of", "river", f"w{rng.randrange(40)}"]) for _ in range(rng.randrange(0, 60)))) for i in range(150)] + [(900, None), (901, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in ctw.scores(df, crc_mod(F.col("doc_id"), 7) == 2, head=head).collect()}
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    count = collections.Counter()
    for d, t in rows:
        if not held(d):
            count.update([*WORD.findall(lower(t or "")), "\n"])
    n, v = sum(count.values()), len(count)
    for d, t in rows:
        w = [*WORD.findall(lower(t or "")), "\n"]
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(d), len(w), sum(count[x] > 0 for x in w), n)
        assert abs(r.base_score - sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)) < 1e-5
    long_ = [got[d] for d, t in rows if len(t or "") > 60]
    assert sum(r.score for r in long_) > 1.6 * sum(r.base_score for r in long_)
    if head > 4:
        assert len(ctw.scores(odd, F.lit(False)).collect()) == odd.count() and ctw.scores(none, F.lit(False)).collect() == []


def test_predictions_are_proper():
    """Over all bytes, the probabilities of a context sum to one; counts of a batch equal a count by hand."""
    text = pa.array(["the river of the house and the tree"] * 3 + ["other words"], pa.large_string())
    code, _ = ctw.coded_bytes(text)
    seen, n = np.unique(code, return_counts=True)
    assert n.sum() == 3 * 36 + 12
    model = ctw.weighted(ctw._counted(0, seen, n))
    for context in (b"\n\n\n\n\n", b" the ", b"zzzzz"):
        base = int.from_bytes(context) << 8
        assert abs((10 ** ctw.logs(np.array([base | b for b in range(256)], np.uint64), model)).sum() - 1) < 1e-9


def test_slices():
    texts = pa.array(["x y", "A b c ", None, "d  e f g", "", "h i j k l m n o p", " q r s t u v"] * 300)
    batch = pa.RecordBatch.from_arrays([texts], ["t"])
    for i, j in ((0, 5), (3, 9), (700, 900), (2000, 100)):
        c = strings(batch.slice(i, j).column(0))
        flat, at = words_of(pa.compute.ascii_lower(c))
        want = [(x or "").lower().split() for x in texts.to_pylist()[i : i + j]]
        assert [flat.to_pylist()[a:b] for a, b in zip(at[:-1], at[1:])] == want
    assert hash_strings(pa.array(["b", "a"]))[1] == hash_strings(pa.array(["a"]))[0]


def test_odd_documents(odd, none):
    assert len(jaccard.linked(odd).collect()) == odd.count() and jaccard.linked(none).collect() == []
    assert len(suffixes.removed(odd).collect()) == odd.count() and suffixes.removed(none).collect() == []
    once, cut = jaccard.one_of_each(odd), suffixes.without_repeats(odd)
    assert once.columns == odd.columns and cut.columns == odd.columns and cut.count() == odd.count()
    assert sum(r.text is not None and r.text.strip() != "" for r in once.collect()) == 8


def exact_log(learnt, grams):
    """log10 probabilities by context-tree weighting with a dictionary of whole contexts."""
    counts, children = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(set)
    steps = [(k, lambda b, k=k: (1 << k) | (b >> (8 - k)), lambda b, k=k: (b >> (7 - k)) & 1) for k in range(8)]
    for g, n in learnt.items():
        for _, node, bit in steps:
            for d in range(ctw.DEPTH + 1):
                context = tuple((g >> 8 * j) & 255 for j in range(1, d + 1))
                counts[context, node(g & 255)][bit(g & 255)] += n
                if d:
                    children[context[:-1], node(g & 255)].add(context)
    weights = {}

    def total(context, node):
        a, b = counts[context, node]
        kt = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        if (context, node) not in children:
            weights[context, node] = 1.0
            return kt
        deep = sum(total(x, node) for x in children[context, node])
        both = max(kt, deep) + math.log(math.exp(kt - max(kt, deep)) + math.exp(deep - max(kt, deep))) - math.log(2)
        weights[context, node] = math.exp(kt - math.log(2) - both)
        return both

    for _, node in [x for x in list(counts) if x[0] == ()]:
        total((), node)
    out = []
    for g in grams:
        log = 0.0
        for _, node, bit in steps:
            mix, known = 0.5, False
            for d in range(ctw.DEPTH, -1, -1):
                at = tuple((g >> 8 * j) & 255 for j in range(1, d + 1)), node(g & 255)
                if at in weights:
                    w = weights[at] if known else 1.0
                    mix, known = w * (counts[at][1] + 0.5) / (sum(counts[at]) + 1) + (1 - w) * mix, True
            log += math.log10(mix if bit(g & 255) else 1 - mix)
        out.append(log)
    return out


@pytest.mark.parametrize("head", [1 << 20, 4])
def test_scores_are_those_of_exact_contexts(spark, head):
    """Every context counts for itself, at any number of contexts; one never seen leaves the prediction to its parent."""
    rng = random.Random(3)
    rows = [(i, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(0, 40)))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in ctw.scores(df, F.col("doc_id") % 5 == 2, head=head).collect()}
    code, ends = ctw.coded_bytes(pa.array([t for _, t in rows], pa.large_string()))
    own = [[int(x) for x in code[a:b]] for a, b in zip(ends[:-1], ends[1:])]
    want = exact_log(collections.Counter(x for i, xs in enumerate(own) if i % 5 != 2 for x in xs), [x for xs in own for x in xs])
    for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
        assert abs(got[i].score - sum(want[a:b])) < 1e-5
