"""Token, packing, mixing, repetition and near-duplicate operators against brute force."""

import itertools
import random

import numpy as np
import pytest

from loomline.llm import mixing, neardup, packing, repetition, tokens

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


def test_budget_is_exact(spark):
    rng = random.Random(0)
    rows = [("a", "Größe übertrifft die Schätzung, isn't it?  \n\n x=1"), ("a", None), (None, ""), ("b", "日本語のテキスト 😀 and more"), *[("c", sentence(rng, 50)) for _ in range(50)], ("d", "y " * 30000)]
    df = spark.createDataFrame(rows, "src string, text string")
    got = {r.src: (r.n_docs, r.n_chars, r.n_tokens) for r in tokens.token_budget(df, ["src"]).collect()}
    enc = tokens.encoder()
    for s in ("a", "b", "c", "d", None):
        own = [t or "" for k, t in rows if k == s]
        assert got[s] == (len(own), sum(map(len, own)), sum(len(enc.encode_ordinary(t)) for t in own))
    assert tokens.token_budget(df.where("false"), ["src"]).count() == 0


@pytest.mark.parametrize("capacity", [7, 64, 256])
def test_plan_uses_everything_within_capacity(capacity):
    rng = np.random.default_rng(capacity)
    counts = np.bincount(rng.integers(1, capacity + 1, 500), minlength=capacity + 1)
    used = np.zeros_like(counts)
    boxes = 0
    for n, p in packing.plan(counts, capacity):
        assert n > 0 and sum(k * v for k, v in p.items()) <= capacity
        boxes += n
        for k, v in p.items():
            used[k] += n * v
    assert (used == counts).all()
    least = -(-int((counts * np.arange(capacity + 1)).sum()) // capacity)
    assert boxes <= 11 / 9 * max(least, int(counts[capacity // 2 + 1 :].sum())) + 1


def skewed_lengths(seed, n, capacity):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(capacity, np.maximum(1, rng.lognormal(np.log(capacity) - 2.2, 1.0, n).astype(int)))
    return np.bincount(lengths, minlength=capacity + 1)


@pytest.mark.parametrize("capacity", [1024, 4096])
def test_tiers_use_fewer_boxes_than_one(capacity):
    lengths = np.random.default_rng(0).integers(int(capacity * 0.12), int(capacity * 0.55), 3000)
    counts = np.bincount(lengths, minlength=capacity + 1)
    many, one = packing.plan(counts, capacity), packing.plan(counts, capacity, [capacity])
    boxes = sum(n for n, _ in many)
    assert boxes < sum(n for n, _ in one)
    assert boxes <= 1.02 * -(-int(lengths.sum()) // capacity)


def test_step_groups_are_balanced(spark):
    counts = skewed_lengths(1, 9000, 512)
    rows = [(f"{n}-{i}", n) for n in np.flatnonzero(counts).tolist() for i in range(int(counts[n]))]
    got = packing.pack(spark.createDataFrame(rows, "doc_id string, n_tokens long"), {"b": 512}).collect()
    tokens_of, boxes_of = {}, {}
    for r in got:
        tokens_of[r.step_group] = tokens_of.get(r.step_group, 0) + r.token_count
        boxes_of.setdefault(r.step_group, set()).add(r.box_no)
    assert len(tokens_of) > 4 and min(len(b) for b in boxes_of.values()) >= packing.STEP_BOXES
    mean = sum(tokens_of.values()) / len(tokens_of)
    assert all(abs(t / mean - 1) < 0.01 for t in tokens_of.values())


def test_pack_frames(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([1, 5, 30, 64, 64, 200])) for i in range(300)] + [(1000, 0), (1001, None)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    got = packing.pack(df, {"s": 64, "l": 256}).collect()
    for b, c in (("s", 64), ("l", 256)):
        own = [r for r in got if r.box_id == b]
        fill = {}
        for r in own:
            if r.box_no is not None:
                fill[r.box_no] = fill.get(r.box_no, 0) + r.token_count
        assert max(fill.values()) <= c and set(fill) == set(range(len(fill)))
        per = {}
        for r in own:
            per[r.doc_id] = per.get(r.doc_id, 0) + r.token_count
        assert all(per[i] == (n or 0) for i, n in rows)
        assert all(sum(1 for r in own if r.doc_id == i) == 1 for i, n in rows if (n or 0) <= c)
    assert packing.pack(df.where("false"), {"s": 64}).count() == 0


def test_fill_exactly_against_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        counts = {rng.randint(1, 12): rng.randint(1, 3) for _ in range(4)}
        items = [n for n, c in counts.items() for _ in range(c)]
        sums = {sum(s) for r in range(len(items) + 1) for s in itertools.combinations(items, r)}
        want = rng.randint(0, sum(items) + 3)
        got = mixing.fill_exactly(counts, want, 1)
        assert all(0 <= got.get(n, 0) <= counts[n] for n in counts) and set(got) <= set(counts)
        total = sum(n * c for n, c in got.items())
        assert total == max(s for s in sums if s <= want)


def test_long_lengths_are_fitted_like_short_ones():
    assert mixing.fill_exactly({20_000: 40, 7: 20}, 30_000) == {20_000: 1, 7: 20}
    huge = {1_000_000: 3, 70_000: 5, 900: 400}
    for budget in (10, 900, 69_999, 1_360_000, 2_400_000):
        got = mixing.fill_exactly(huge, budget)
        assert all(got[n] <= huge[n] for n in got)
        assert 0 <= budget - sum(n * c for n, c in got.items()) < 900


def test_proportion_favours_no_length():
    counts = {n: 50 for n in range(1, 2001, 7)}
    total = sum(n * c for n, c in counts.items())
    got = mixing.fill_exactly(counts, total // 2, 5)
    assert sum(n * c for n, c in got.items()) == total // 2
    for low in range(1, 2001, 500):
        part = [n for n in counts if low <= n < low + 500]
        assert abs(sum(got.get(n, 0) for n in part) / sum(counts[n] for n in part) - 0.5) < 0.08


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_mix_with_huge_documents(spark, seed):
    rows = [(i, "a", 20_000) for i in range(40)] + [(100 + i, "a", 7) for i in range(20)] + [(200 + i, "b", 50) for i in range(600)]
    df = spark.createDataFrame(rows + [(999, "c", 300_000)], "doc_id long, source string, n_tokens long")
    total = {}
    for r in mixing.mix(df, [("m", "a", 1.0, 1), ("m", "b", 1.0, 1), ("n", "b", 1.0, 1), ("n", "c", 10.0, 1)], seed).collect():
        total[r.mix_id, r.source] = total.get((r.mix_id, r.source), 0) + r.n_tokens * r.repeats
    assert total == {("m", "a"): 20_140, ("m", "b"): 30_000, ("n", "b"): 30_000, ("n", "c"): 300_000}


def test_mix_reaches_shares(spark):
    rng = random.Random(3)
    rows = [(i, "big" if i % 5 else "small", rng.randint(1, 300)) for i in range(1500)] + [(9001, None, 5), (9002, "big", 0), (9003, "big", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = [("m", "big", 1.0, 1), ("m", "small", 1.0, 3), ("m", "gone", 2.0, 2), ("z", "gone", 1.0, 1)]
    got = mixing.mix(df, targets).collect()
    total = {}
    for r in got:
        total[r.source] = total.get(r.source, 0) + r.n_tokens * r.repeats
        assert r.repeats <= (1 if r.source == "big" else 3) and r.mix_id == "m"
    assert abs(total["big"] - total["small"]) <= 1
    assert len({r.doc_id for r in got}) == len(got)
    assert mixing.mix(df.where("false"), targets).count() == 0


def brute_share(ws):
    n = len(ws)
    hit = [False] * n
    for i in range(n - 7):
        if any(ws[j : j + 8] == ws[i : i + 8] for j in range(i)):
            for k in range(i, i + 8):
                hit[k] = True
    return sum(hit) / n if n else 0.0


def test_repetition_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(0, None), (1, ""), (2, "a " * 200), (3, "七" * 40)]
    for i in range(4, 120):
        t = sentence(rng, rng.randint(1, 60))
        if i % 3 == 0:
            cut = t.split()[: rng.randint(5, 30)]
            t += " " + " ".join(cut) * rng.randint(1, 3)
        rows.append((i, t))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in repetition.measure_repetition(df).collect()}
    for i, t in rows:
        want = brute_share(repetition.words(t))
        assert abs(repetition.repeated_share(repetition.words(t)) - want) < 1e-12
        if got[i].repeated_share is None:
            assert want < 0.3
        else:
            assert abs(got[i].repeated_share - want) < 1e-12
    assert repetition.measure_repetition(df.where("false")).count() == 0


def test_share_of_every_document(spark):
    run = "one two three four five six seven eight"
    fill = [" ".join(f"{chr(97 + i)}{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(84)) for i in range(26)]
    docs = [(0, f"{run} {fill[0]} {run}"), (1, fill[1]), (2, None), (3, "")] + [(4 + i, f) for i, f in enumerate(fill[2:])]
    got = {r.doc_id: r.repeated_share for r in repetition.measure_repetition(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert abs(got.pop(0) - 0.08) < 1e-12
    assert len(got) == len(docs) - 1 and set(got.values()) == {0.0}


def test_words_follow_the_definition():
    assert repetition.words("Ab12cd, 3.4 é－漢字カナx") == ["ab0cd", "0", "0", "é", "漢", "字", "カ", "ナ", "x"]


def corpus(spark):
    from datetime import datetime

    rng = random.Random(5)
    rows = []
    day = lambda k: datetime(2024, 1, 1 + k)
    for i in range(60):
        ws = sentence(rng, 60).split()
        rows.append((f"b{i:03}", day(0), " ".join(ws)))
        for k in range(i % 3):
            v = list(ws)
            for _ in range(rng.randint(1, 6)):
                v[rng.randrange(len(v))] = "edit" + str(rng.randint(0, 9))
            rows.append((f"v{i:03}{k}", day(0), " ".join(v)))
    hot = sentence(rng, 40)
    rows += [(f"h{i:03}", day(0), hot if i % 2 else hot.upper() + "!") for i in range(40)]
    rows += [("old", day(0), hot), ("old", day(1), sentence(rng, 40)), ("old", day(1), rows[-1][2]), ("short", day(0), "a b c"), ("none", day(0), None), ("empty", day(0), "")]
    return spark.createDataFrame(rows[:-4] + rows[-3:], "doc_id string, stored_at timestamp, text string")


def brute_pairs(df, threshold=0.6):
    now = {}
    for r in df.collect():
        if r.doc_id not in now or r.stored_at > now[r.doc_id].stored_at:
            now[r.doc_id] = r
    sets = {d: neardup.triples(neardup.words(r.text)) for d, r in now.items() if len(neardup.words(r.text)) >= 30}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def test_near_duplicates_against_brute_force(spark):
    df = corpus(spark)
    members, links = neardup.near_duplicates(df, df.count())
    got = {(r.doc_id_a, r.doc_id_b) for r in neardup.document_pairs(members, links).collect()}
    want = brute_pairs(df)
    assert got <= want and len(got & want) / len(want) >= 0.98


def test_crowded_nodes_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(neardup, "NODE", 2)
    monkeypatch.setattr(neardup.node_pairs, "__defaults__", (2,))
    df = corpus(spark)
    members, links = neardup.near_duplicates(df, df.count())
    got = {(r.doc_id_a, r.doc_id_b) for r in neardup.document_pairs(members, links).collect()}
    want = brute_pairs(df)
    assert got <= want and len(got & want) / len(want) >= 0.98


def test_large_class_links_to_its_representative(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LISTED", 5)
    df = corpus(spark)
    members, links = neardup.near_duplicates(df, df.count())
    got = {(r.doc_id_a, r.doc_id_b) for r in neardup.document_pairs(members, links).collect() if r.doc_id_a.startswith("h") and r.doc_id_b.startswith("h")}
    assert got == {("h000", f"h{i:03}") for i in range(1, 40)}


def test_large_class_of_different_texts_lists_every_pair(spark, monkeypatch):
    from datetime import datetime

    monkeypatch.setattr(neardup, "BLOCK", 16, raising=False)
    ws = [f"word{i}" for i in range(60)]
    spelled = lambda ws, i: " ".join(w.upper() if i >> k & 1 else w for k, w in enumerate(ws))
    rows = [(f"v{i:03}", datetime(2024, 1, 1), spelled(ws, i)) for i in range(70)] + [(f"x{i:03}", datetime(2024, 1, 1), spelled([*ws[:-1], "other"], i)) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id string, stored_at timestamp, text string")
    monkeypatch.setattr(neardup, "_corpus", lambda *_: neardup.near_duplicates(df, df.count()))
    got = [tuple(r) for r in neardup.p3_found(spark, "").collect()]
    want = set(itertools.combinations(sorted(r[0] for r in rows), 2))
    assert len(got) == len(want) and set(got) == want


def test_near_duplicates_of_nothing(spark):
    df = corpus(spark).where("false")
    members, links = neardup.near_duplicates(df, 0)
    assert neardup.document_pairs(members, links).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (200, 200)]
    got = {r.node: r.component for r in neardup.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_the_score_decides_what_is_measured(spark, sf):
    docs = corpus_texts(spark, sf)
    every = {r.doc_id: r for r in repetition.measure_repetition(docs).collect()}
    gated = {r.doc_id: r for r in repetition.measure_repetition(docs, least=0.3).collect()}
    true = {i for i, r in every.items() if r.repeated_share >= 0.3}
    passed = {i for i, r in gated.items() if r.repeated_share is not None}
    assert true and true <= passed
    assert len(passed) < 0.15 * len(every) and len(true) / len(passed) > 0.3
    assert min(every[i].repetition_score for i in true) > max(r.repetition_score for i, r in every.items() if i not in passed)


def corpus_texts(spark, sf):
    return spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")


def test_prefixes_are_shortened_until_the_recall_is_reached(spark):
    from datetime import datetime

    rng = random.Random(9)

    def pairs_with(edits, n=60):
        rows = []
        for i in range(n):
            ws = sentence(rng, 90).split()
            rows.append((f"a{i}", datetime(2024, 1, 1), " ".join(ws)))
            for k in range(edits):
                ws[3 + k * (84 // max(1, edits))] = f"other{k}"
            rows.append((f"b{i}", datetime(2024, 1, 1), " ".join(ws)))
        return spark.createDataFrame(rows, "doc_id string, stored_at timestamp, text string")

    close, far = [], []
    assert neardup.near_duplicates(pairs_with(1), 120, report=close)[1].count() == 60
    links = neardup.near_duplicates(pairs_with(7), 120, report=far)[1].count()
    trees, least, length = neardup.plan_forest(120)
    assert [r[0] for r in close] == [length] and close[0][2] >= neardup.TARGET
    assert [r[0] for r in far] == [length, least]
    assert far[0][1] <= links and links >= 59 and far[0][2] < far[1][2]


def test_labels_are_sorted_prefixes():
    docs = [sentence(random.Random(i % 3), 40).split() for i in range(6)]
    keys, _ = neardup.forest_keys(docs, neardup._Ids(), 5, 4)
    longer, _ = neardup.forest_keys(docs, neardup._Ids(), 5, 4)
    assert (keys == longer).all() and (keys[:3] == keys[3:]).all()
    assert len({tuple(k) for k in keys.tolist()}) == 3
    assert neardup.recall_at(0.6, *neardup.plan_forest(300_000)[1::-1]) >= neardup.RECALL


def test_many_trees_take_little_disk_at_once(spark, monkeypatch):
    from loomline import session

    plan, pairs = neardup.plan_forest(12_000_000), neardup.node_pairs
    widths = []

    def watched(classes, *args):
        widths.append(classes.selectExpr("max(size(nodes))").first()[0])
        return pairs(classes, *args)

    monkeypatch.setattr(neardup, "plan_forest", lambda *_: plan)
    monkeypatch.setattr(neardup, "node_pairs", watched)
    df = corpus(spark)
    written = len([p for p in session._WRITTEN if "loomline-signed-" in p])
    members, links = neardup.near_duplicates(df, df.count())
    got = {(r.doc_id_a, r.doc_id_b) for r in neardup.document_pairs(members, links).collect()}
    want = brute_pairs(df)
    assert got <= want and len(got & want) / len(want) >= 0.98
    assert sum(widths) == plan[0] > 100 and max(widths) <= 32
    assert len([p for p in session._WRITTEN if "loomline-signed-" in p]) == written


def test_pairs_are_listed_once_without_a_shuffle_of_them(spark):
    df = corpus(spark)
    members, links = neardup.near_duplicates(df, df.count())
    for compact in (True, False):
        pairs = neardup.document_pairs(members, links.unionByName(links), compact)
        got = [tuple(r) for r in pairs.collect()]
        assert got and len(set(got)) == len(got)
        assert not pairs._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")
    assert set(got) <= brute_pairs(df)


def test_labels_of_half_of_many_trees_are_written_at_once(spark, monkeypatch):
    plan, sign = neardup.plan_forest(12_000_000), neardup.sign
    widths = []

    def watched(texts, trees, *args):
        widths.append(trees)
        return sign(texts, trees, *args)

    monkeypatch.setattr(neardup, "plan_forest", lambda *_: plan)
    monkeypatch.setattr(neardup, "sign", watched)
    neardup.near_duplicates(corpus(spark), 100)
    assert sum(widths) == plan[0] and max(widths) <= 64
    # sketches come from the first trees alone
    assert widths[0] * plan[2] >= neardup.SKETCH


def test_written_tables_leave_no_shuffle_files(spark):
    from loomline import session

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x for x in disk.getAllFiles().mkString(" ").split() if "shuffle_" in x}
    before = files()
    kept = session.materialise(spark.range(5000).selectExpr("id % 700 as k").groupBy("k").count(), "test")
    assert not files() - before
    assert kept.count() == 700
    session.discard(kept)
    assert not [p for p in session._WRITTEN if "loomline-test-" in p]
