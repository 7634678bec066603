"""Inner parts of the corpus operators against brute force."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paceline.llm import catalog, chat, mixing, packing, quality, secret_scan, simhash, toxicity
from paceline.llm.common import spread_join
from paceline.llm.components import components
from paceline.llm.line_dedup import LineRuns
from paceline.session import cut_lineage


def test_anchors_bring_together_what_is_three_bits_apart(spark):
    rng = np.random.default_rng(1)
    one = rng.integers(0, 1 << 64, 150, dtype=np.uint64)
    two = one.copy()
    for at in range(len(one)):
        for bit in rng.choice(64, at % 4, replace=False):
            two[at] ^= np.uint64(1) << np.uint64(bit)
    both = [(int(x),) for x in np.r_[one, two, np.array([0, 1, 1 << 31, 0xFFFFFFFFFFFFFFFF], np.uint64)].view(np.int64)]
    rows = simhash.anchor_rows(spark.createDataFrame(both, "fp bigint").distinct()).collect()
    at = {}
    for r in rows:
        at.setdefault(r["fp"], set()).add(r["anchor"])
    homes = {}
    for r in rows:
        if r["home"]:
            homes.setdefault(r["fp"], set()).add(r["anchor"])
    assert all(len(h) == 2 for h in homes.values()) and max(map(len, at.values())) <= 34
    for a, b in zip(one.view(np.int64).tolist(), two.view(np.int64).tolist(), strict=True):
        assert homes[a] & at[b] and homes[b] & at[a]


@pytest.mark.parametrize("hot", [4096, 8])
def test_links_connect_all_near_fingerprints(spark, hot):
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 64, 20, dtype=np.uint64)
    fps = set()
    for c in centres:
        for _ in range(40):
            x = c
            for bit in rng.choice(64, rng.integers(0, 4), replace=False):
                x ^= np.uint64(1) << np.uint64(bit)
            fps.add(int(x))
    # a chain of small steps
    x = int(rng.integers(0, 1 << 63))
    for bit in range(0, 30):
        x ^= 3 << bit
        fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    links = simhash.fingerprint_links(
        spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp bigint"), hot_anchor=hot).collect()
    pairs = {(r["a"], r["b"]) for r in links}
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 3 for a, b in pairs)

    def groups(edges):
        root = {int(v): int(v) for v in fps.view(np.int64)}

        def find(a):
            while root[a] != a:
                a = root[a]
            return a

        for a, b in edges:
            x, y = sorted((find(a), find(b)))
            root[y] = x
        return {v: find(v) for v in root}

    ints = fps.view(np.int64).tolist()
    whole = [(ints[a], ints[b]) for a in range(len(fps)) for b in np.flatnonzero(
        np.bitwise_count(fps ^ fps[a]) <= 3)]
    assert groups(pairs) == groups(whole)


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, 500 + k) for k in range(1, 200)]
    edges += [tuple(map(int, rng.integers(1000, 1400, 2))) for _ in range(250)] + [(7, 7)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {v: find(v) for v in root if find(v) != v or sum(v in e for e in edges if e[0] != e[1])}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_spread_join(spark):
    left = [(k, "hot" if k % 3 else f"k{k % 50}") for k in range(3000)] + [(9000, None), (9001, "none")]
    right = {}
    for _, key in left:
        if key and key != "none":
            right[key] = right.get(key, 0) + 1
    table = cut_lineage(spark.createDataFrame([(k, n, f"p{k}") for k, n in right.items()], "key string, n bigint, p string"))
    got = spread_join(spark.createDataFrame(left, "id bigint, key string"), table, ["key"], "n", ["p"], F.col("id"))
    assert got.columns == ["id", "key", "p"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        ((i, k, f"p{k}" if k in right else None) for i, k in left), key=str)


def test_runs_in_levels(spark):
    runs, want = LineRuns(fan_in=2), {}
    for batch in range(7):
        rows = [(100 - batch, bytes([v])) for v in range(30) if (v * 7 + batch) % 3]
        for i, line in rows:
            n, owner = want.get(line, (0, 0))
            want[line] = (n + 1, max(owner, i))
        runs.add(spark.createDataFrame(rows, "id bigint, line binary"))
    assert [len(level) for level in runs.levels] == [1, 1, 1]
    got = {bytes(r["line"]): (r["n_alerts"], r["owner_id"]) for r in runs.repeated(3).collect()}
    assert got == {line: v for line, v in want.items() if v[0] >= 3}
    runs.close()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=80), st.integers(60, 64))
def test_best_fit_is_the_tightest_open_bin(lengths, capacity):
    lengths = sorted(lengths, reverse=True)
    bins, offsets = packing.best_fit_decreasing(np.array(lengths, np.int64), capacity)
    rooms = []
    for length, b, o in zip(lengths, bins, offsets, strict=True):
        fits = [r for r in rooms if r >= length]
        if fits:
            assert rooms[b] == min(fits)
        else:
            assert b == len(rooms)
            rooms.append(capacity)
        assert capacity - rooms[b] == o
        rooms[b] -= length


@pytest.fixture(scope="module")
def tokens():
    return packing.WordTokens(catalog.tokenizer_path(), remembered=40)


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(st.one_of(
    st.sampled_from(list("abAZ éÉßİıſKΣσ.,'!?\n\t\r\x0b\x0c\x1c\x85\xa0\u2003\u0301\u0338\u200d0१語🙂<|>")),
    st.characters(codec="utf-8"))), max_size=6))
def test_words_have_the_ids_of_the_whole_text(tokens, texts):
    texts = [*texts, "Plain words, and more. It's the <|endoftext|>end ŉ ǅ ß. Ĳ. don't"]
    got = [np.frombuffer(raw, "<u4").tolist() for raw in tokens.encode(texts, block=50)]
    assert got == [e.ids for e in tokens.tokenizer.encode_batch(texts, add_special_tokens=False)]


@given(st.text(st.sampled_from(list("\\<>|/s[]INST xé\n"))))
def test_escape_round_trip(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    assert not any(c in hidden for c in ("<|", "<s>", "</s>", "[INST]", "[/INST]"))
    assert chat.read_turn(f"<|turn|>{chat.escape(text)}<|text|>{hidden}<|end|>\n") == (text, text)


def test_poisson_steps(spark):
    rates = [0.0001, 0.4, 1.0, 7.5, 900.0]
    got = spark.createDataFrame([(r,) for r in rates], "rate double").select(
        "rate", mixing.poisson_steps(F.col("rate")).alias("steps")).collect()
    for r in got:
        steps = np.array(r["steps"])
        assert abs(steps[-1] - 1) < 1e-9 and (np.diff(steps) >= 0).all()
        mean = (1 - steps).clip(0).sum()
        assert abs(mean - r["rate"]) < 1e-6 * max(1, r["rate"])


def test_shares_follow_the_weights(spark):
    rows = spark.range(6000).select(
        "id", F.when(F.col("id") < 4500, "cam0").when(F.col("id") < 5900, "cam1").otherwise("cam2").alias("stream_id"))
    weights = spark.createDataFrame([("cam0", 1.0), ("cam1", 2.0), ("cam2", 1.0), ("cam9", 5.0)], "stream_id string, weight double")
    mixed = mixing.mix_streams(rows, weights, total=8000)
    n = {r["stream_id"]: r["count"] for r in mixed.groupBy("stream_id").count().collect()}
    assert abs(n["cam0"] - 2000) < 200 and abs(n["cam1"] - 4000) < 260 and abs(n["cam2"] - 2000) < 200
    keys = [r["mix_key"] for r in mixed.collect()]
    assert keys == sorted(keys)
    assert mixed.filter("stream_id = 'cam2'").agg(F.max("copy")).first()[0] > 10


def test_swaps_level_identity_terms(spark):
    rng = np.random.default_rng(4)
    filler = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(400):
        toxic = k % 2
        words = list(rng.choice(filler, 12))
        if toxic and rng.random() < 0.8:
            words.append("scum")
        if rng.random() < (0.6 if toxic else 0.05):  # one group is mentioned in toxic rows by accident
            words.append("visitors")
        rows.append((k, " ".join(map(str, words)), toxic))
    table = spark.createDataFrame(rows, "id bigint, notes string, toxic int")
    free = toxicity.fit_toxicity(table, table.select("id", "toxic"), penalty=0.0)
    tied = toxicity.fit_toxicity(table, table.select("id", "toxic"), penalty=50.0)
    gap = [abs(m.score("w1 w2 visitors") - m.score("w1 w2 guards")) for m in (free, tied)]
    assert gap[1] < 0.25 * gap[0] and tied.score("w1 scum w2") > 0.5 > tied.score("w1 w2 w3")
    assert toxicity.swapped({"a", "guards", "men"}, toxicity.IDENTITY_TERMS) == {"a", "visitors", "women"}


def test_rules_as_columns_score_like_rules_in_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(rng.choice(["ab", "cd", "XX!!", "efg", "| |"], 30)) if k % 3 else "same " * 20, int(k % 3 > 0))
            for k in range(150)]
    table = spark.createDataFrame(rows, "id bigint, notes string, quality int")
    model = quality.fit_quality(table, table.select("id", "quality"))
    assert model.rules and len(quality.describe(model)) == len(model.rules)
    scored = quality.with_statistics(table).withColumn("score", model.column()).collect()
    x = np.array([[r[f"s_{s}"] for s in quality.STATISTICS] for r in scored])
    z = np.stack([r.holds(x) for r in model.rules], axis=1) @ np.array(model.weights) + model.constant
    assert np.allclose(1 / (1 + np.exp(-z)), [r["score"] for r in scored])
    assert np.mean([(r["score"] >= 0.5) == r["quality"] for r in scored]) > 0.95


def test_owners_tell_examples_from_live_secrets(spark):
    live, copied = "f3a9c17be08d42659cc1d7b0a4e8f216", "0badc0ffee1234987650fedcba98abcd"
    wide = "Zx9Qw7Lm2Kp4Tr8Vn3Bc6"
    rows = [(1, "cam0", "a", f"token={live} x"), (2, "cam0", "b", f"token = '{live}'"), (5, "cam5", "a", f"see {wide} é")]
    rows += [(10 + k, f"cam{k}", "a", f"é password: {copied}") for k in range(4)]
    got = {r["id"]: r for r in secret_scan.scan_secrets(
        spark.createDataFrame(rows, "id bigint, stream_id string, zone_id string, notes string")).collect()}
    assert [s["live"] for s in got[1]["spans"]] == [True, True] and got[1]["spans"][0]["n_zones"] == 2
    assert got[11]["n_live"] == 0 and got[11]["n_copied"] == 2 and got[11]["spans"][0]["n_streams"] == 4
    assert [(s["kind"], s["start"], s["end"]) for s in got[5]["spans"]] == [("live", 4, 4 + len(wide))]
    assert got[5]["n_added"] == 1


def test_typed_parts(spark):
    rows = [
        (3, 0, "user", [("text", "look <|image:0|> \\", None, None, None, None, None),
                        ("image", None, "clips/a.jpg", 640, 300, None, None), ("text", "and", None, None, None, None, None),
                        ("audio", None, "clips/a.wav", None, None, 2.5, None)]),
        (3, 1, "assistant", [("text", "seen", None, None, None, None, None)]),
        (3, 2, "user", [("document", None, "reports/1.pdf", None, None, None, 3)]),
        (4, 0, None, None),
    ]
    turns = spark.createDataFrame(rows, f"conv_id bigint, turn int, role string, parts array<{chat.PART}>")
    out = chat.format_dialogues(turns)
    got = {(r["conv_id"], r["turn"]): r for r in out.collect()}
    assert [(a["number"], a["kind"], a["uri"], a["tokens"]) for a in got[3, 0]["attachments"]] == [
        (0, "image", "clips/a.jpg", 23 * 11), (1, "audio", "clips/a.wav", 63)]
    assert [(a["number"], a["tokens"]) for a in got[3, 2]["attachments"]] == [(2, 3 * 768)]
    assert got[3, 0]["formatted"].endswith("<|image:0|>and<|audio:1|><|end|>\n")
    assert got[3, 0]["formatted"].count("<|image:0|>") == 1 and got[4, 0]["tokens_expanded"] == 0
    whole = "".join(got[3, k]["formatted"] for k in range(3))
    assert whole[got[3, 1]["loss_start"]:got[3, 1]["loss_end"]] == "seen"
    back = {r["conv_id"]: r for r in chat.read_back(out).collect()}
    assert back[3]["loss_chars"] == 4 and back[3]["formatted_chars"] == len(whole) and back[4]["n_turns"] == 1
