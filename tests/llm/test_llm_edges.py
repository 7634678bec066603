"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paceline.llm import catalog, chat, embeddings, exact_dedup, line_dedup, mixing, packing, quality, secret_scan
from paceline.llm import simhash, toxicity

LINE = "The side door of the hall was open again"
LONG = " ".join(f"word{k % 977}" for k in range(60_000)) + "\n" + LINE
ALERTS = [
    (1, None, "cam0", "a"), (2, "", "cam0", None), (3, f"{LINE}\nfirst", None, "a"), (4, f"{LINE}\nsecond", "cam1", "b"),
    (5, f"  {LINE.upper()} \t\nthird\n\n", "cam1", "b"), (6, LONG, "cam0", "a"), (7, LONG, "cam0", "a"),
    (8, " \t\n", "cam2", "c"), (None, f"{LINE}\nfourth", None, None), (9, "a\x00b é 語 🙂", "cam0", "a"),
]
SCHEMA = "id bigint, notes string, stream_id string, zone_id string"
#: Names that operators use for results or inside.
CLASH = ("score", "predicted", "n_lines", "n_dropped", "copy", "mix_key", "component_id", "fingerprint", "keep_id", "row",
         "value", "line", "pos", "n", "toxic", "quality", "s_chars", "found", "batch", "length", "piece", "digest", "kept")


@pytest.fixture(scope="module")
def alerts(spark):
    df = spark.createDataFrame(ALERTS, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(k, k % 2, 1 - k % 2) for k in range(1, 9)] + [(9, None, None), (3, 1, 0), (None, 1, 1), (4, 7, 7)],
        "id bigint, toxic int, quality int")


def by_id(df):
    rows = {}
    for r in df.collect():
        rows.setdefault(r["id"], []).append(r)
    assert all(len(v) == 1 for v in rows.values())
    return {i: v[0] for i, v in rows.items()}


def test_line_dedup(alerts, empty):
    got = by_id(line_dedup.drop_repeated_lines(alerts))
    assert len(got) == len(ALERTS)
    assert got[1]["notes"] == "" and got[1]["n_lines"] == 1 and got[2]["n_dropped"] == 0
    assert got[3]["notes"] == "first" and got[4]["notes"] == "second" and got[5]["notes"] == "third\n\n"
    assert got[None]["notes"] == "fourth" and got[None]["n_dropped"] == 1
    assert got[7]["notes"] == LONG and got[6]["notes"] == LONG.split("\n")[0]  # two alerts have the long line, six the other
    assert got[8]["notes"] == " \t\n" and got[9]["notes"] == "a\x00b é 語 🙂"
    assert got[3]["score"] == "clash" and got[3]["n_lines"] == 2
    assert line_dedup.drop_repeated_lines(empty).count() == 0


def plain_lines(rows):
    """``id, lines that stay, n_dropped`` of each row; rows of one id count as one alert."""
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})

    held = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                held.setdefault(key(line), set()).add(-1 if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(held.get(key(x), ())) < 3 or max(held[key(x)]) == (-1 if i is None else i)]
        out.append((i, "\n".join(stay), len(lines) - len(stay)))
    return sorted(out, key=str)


def test_line_dedup_of_repeated_ids(spark):
    """Rows that share an id keep and lose their own lines."""
    own, shared = "a line that only this row of the log holds", [f"a line that is found in many rows, number {k}" for k in range(6)]
    cases = [
        [(1, f"{shared[0]}\n{own}\n{shared[0]}\nb")] * 2 + [(2, shared[0]), (3, shared[0])],
        [(1, f"{shared[0]}\nown a"), (1, "zzz\nyyy"), (2, shared[0]), (3, shared[0])],
    ]
    rng = np.random.default_rng(4)
    for _ in range(2):
        cases.append([
            (None if rng.random() < 0.1 else int(rng.integers(0, 12)),
             "\n".join([*rng.choice(shared, int(rng.integers(0, 4))), own + str(rng.integers(0, 9))][:int(rng.integers(1, 5))]))
            for _ in range(40)])
    for rows in cases:
        log = spark.createDataFrame(rows, "id bigint, notes string")
        for batches, fan_in in ((5, 3), (2, 2)):
            got = line_dedup.drop_repeated_lines(log, batches=batches, fan_in=fan_in).collect()
            assert sorted(((r["id"], r["notes"], r["n_dropped"]) for r in got), key=str) == plain_lines(rows)


def test_lines_lost_in_number(spark):
    lines = [f"line number {k} of many lines" for k in range(3000)]
    rows = [(k, "\n".join(["own"] + lines + [f"mine {k}"] + lines[:5])) for k in range(3)]
    got = by_id(line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "id bigint, notes string")))
    assert [got[k]["n_dropped"] for k in range(3)] == [3005, 3005, 0] and got[0]["notes"] == "own\nmine 0"
    assert got[2]["notes"] == rows[2][1]


def test_exact_dedup(spark, alerts, empty):
    got = by_id(exact_dedup.exact_duplicates(alerts, rows_per_run=2, fan_in=2))
    assert [got[k]["keep_id"] for k in (1, 2, 8)] == [8, 8, 8] and got[8]["kept"] and got[1]["group_size"] == 3
    assert got[1]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[7]["keep_id"] == 6 and not got[7]["kept"] and got[None]["kept"] and got[None]["keep_id"] is None
    assert exact_dedup.exact_duplicates(empty).count() == 0
    tie = spark.createDataFrame([(5, "a b"), (5, "a b"), (3, "ab"), (7, "a  b"), (8, "a\n b"), (None, "a  b")],
                                "id bigint, notes string")
    rows = exact_dedup.exact_duplicates(tie).collect()
    assert {(r["keep_id"], r["group_size"]) for r in rows} == {(7, 6)} and sum(r["kept"] for r in rows) == 1


def test_simhash(spark, alerts, empty):
    got = by_id(simhash.near_duplicates(alerts))
    assert [got[k]["component_id"] for k in (1, 2, 8)] == [1, 1, 1] and got[1]["fingerprint"] == "0" * 16
    assert got[7]["component_id"] == 6 and got[None]["component_id"] is None
    assert simhash.near_duplicates(empty).count() == 0
    twice = spark.createDataFrame([(4, "x y"), (4, "x y"), (2, "X  Y")], "id bigint, notes string")
    assert [r["component_id"] for r in simhash.near_duplicates(twice).collect()] == [2, 2, 2]
    with pytest.raises(ValueError):
        simhash.near_duplicates(alerts, bits=4)


def test_secrets(spark, alerts, empty):
    got = by_id(secret_scan.scan_secrets(alerts))
    assert len(got) == len(ALERTS) and got[1]["spans"] == [] and got[6]["n_hex"] == 0
    assert secret_scan.scan_secrets(empty).count() == 0
    twice = spark.createDataFrame([(1, "🙂 API_KEY='abc123=' token: x", None, None)] * 2, SCHEMA)
    for r in secret_scan.scan_secrets(twice).collect():
        assert [(s["kind"], s["start"], s["end"], s["n_streams"]) for s in r["spans"]] == [("assign", 2, 18, 1)]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (1, 0, 0)


@pytest.mark.parametrize("fit, score", [(toxicity.fit_toxicity, toxicity.score_toxicity), (quality.fit_quality, quality.score_quality)])
def test_classifiers(alerts, empty, labels, fit, score):
    model = fit(alerts, labels)
    got = by_id(score(alerts, model))
    assert len(got) == len(ALERTS) and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[1]["score"] == got[2]["score"] and got[6]["score"] == got[7]["score"] and got[3]["kept"] == "clash"
    assert score(empty, model).count() == 0
    for none in (fit(empty, labels), fit(alerts, labels.limit(0))):
        assert {r["score"] for r in score(alerts, none).collect()} == {0.5}


def test_packing(alerts, empty):
    path = catalog.tokenizer_path()
    got = packing.pack_notes(alerts, path, pieces_per_group=5).collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r["id"], []).append(r)
    assert set(pieces) == {a[0] for a in ALERTS} and pieces[1][0]["length"] == 1
    for rows in pieces.values():
        rows.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in rows] == list(range(len(rows)))
        assert [r["start"] for r in rows] == [2048 * r["piece"] for r in rows]
        assert all(r["length"] == 2048 for r in rows[:-1])
    assert len(pieces[6]) > 20
    assert packing.pack_notes(empty, path).count() == 0
    ids = packing.note_pieces(alerts, path, with_ids=True).filter("id = 9").first()
    assert len(ids["ids"]) == 4 * ids["length"]


def test_mixing(spark, alerts, empty):
    same = [r["id"] for r in mixing.mix_streams(alerts.select("id", "stream_id", "copy")).collect()]
    assert same == [r["id"] for r in mixing.mix_streams(alerts.select("stream_id", "id")).collect()]
    many = mixing.mix_streams(alerts, total=200)
    assert set(many.columns) == {*alerts.columns} and {r["id"] for r in many.collect()} == {a[0] for a in ALERTS}
    assert mixing.mix_streams(empty).count() == 0
    none = spark.createDataFrame([("elsewhere", 1.0)], "stream_id string, weight double")
    assert mixing.mix_streams(alerts, none).count() == 0
    one = spark.createDataFrame([(None, 1.0)], "stream_id string, weight double")
    assert {r["id"] for r in mixing.mix_streams(alerts, one, total=500).collect()} == {3, None}


def test_chat(spark):
    rows = [(1, 0, None, None), (1, 1, "assistant", ""), (None, 0, "user", "x" * 500_000), (2, 0, "assistant", "<|end|>\n"),
            (2, 0, "assistant", "<|end|>\n")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns(
        {"parts": chat.text_part(F.col("text")), "start": F.lit("clash"), "formatted": F.lit("clash")})
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_dialogues(turns)).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"\n\nassistant\n\n").hexdigest()
    assert got[None]["n_turns"] == 1 and got[None]["loss_chars"] == 0
    assert got[2]["n_turns"] == 2 and got[2]["loss_sha256"] == hashlib.sha256(b"<|end|>\n<|end|>\n").hexdigest()
    assert chat.read_back(chat.format_dialogues(turns.limit(0))).count() == 0


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, "a", [1.0, 0.0]), (2, "a", [2.0, 0.1]), (3, "a", [1.0, 0.0]), (4, "a", [0.0, 1.0]), (5, "a", [0.0, 0.0]),
        (6, "a", None), (7, "a", []), (8, "a", [1.0, None]), (9, "a", [nan, 1.0]), (10, "a", [inf, 1.0]),
        (11, None, [1.0, 0.0]), (12, "b", [1.0, 0.0]), (13, "a", [1.0, 0.0, 0.0]), (3, "a", [1.0, 0.0]),
        (14, "a", [3e38, 0.0]), (15, "a", [-1.0, -0.0]), (16, "a", [1e-40, -0.0]),
    ]
    df = spark.createDataFrame(rows, "track_id bigint, stream_id string, embedding array<float>").withColumns(
        {c: F.lit("clash") for c in ("digest", "rep", "n", "root", "row", "unit", "dim", "leaf")})
    got = sorted((r["track_id"], r["n_links"], r["component_id"], r["kept"]) for r in
                 embeddings.near_duplicate_embeddings(df).collect())
    alone = [4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 15]
    assert got == sorted([(k, 5, 1, k == 1) for k in (1, 2, 3, 3, 14, 16)] + [(k, 0, k, True) for k in alone])
    assert embeddings.near_duplicate_embeddings(df.limit(0)).count() == 0
    assert embeddings.near_duplicate_embeddings(df.filter("track_id = 6")).count() == 1


def test_embeddings_against_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    x = rng.normal(size=(240, 8))
    x[60:180] = x[rng.integers(0, 60, 120)] + rng.normal(size=(120, 8)) * rng.choice([0.0, 0.2, 0.5], 120)[:, None]
    stream = rng.integers(0, 3, 240)
    x = x.astype(np.float32).astype(np.float64)
    df = spark.createDataFrame(
        [(k, int(stream[k]), [float(v) for v in x[k]]) for k in range(240)],
        "track_id bigint, stream_id int, embedding array<float>")
    got = {r["track_id"]: (r["n_links"], r["component_id"]) for r in
           embeddings.near_duplicate_embeddings(df, leaf=8, fan=2).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    link = (unit @ unit.T >= 0.93) & (stream[:, None] == stream[None, :]) & ~np.eye(240, dtype=bool)
    root = list(range(240))
    changed = True
    while changed:
        changed = False
        for a in range(240):
            low = min([root[a], *(root[b] for b in np.flatnonzero(link[a]))])
            changed |= low != root[a]
            root[a] = low
    assert got == {k: (int(link[k].sum()), root[k]) for k in range(240)} and link.any()


def test_pipeline_on_odd_documents(spark, tmp_path):
    documents = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(i, t, z, s, None) for i, t, s, z in ALERTS]
    table = spark.createDataFrame(rows, documents).withColumns({"score": F.lit(1), "id": F.lit(1), "notes": F.lit(2)})
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, k % 2) for k in range(1, 9)], "doc_id bigint, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == list(corpus_pipeline.COLUMNS) and out.count() > 0
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 20
    assert corpus_pipeline.run(spark, str(tmp_path)).columns[:2] == ["doc_id", "piece"]
