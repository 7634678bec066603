"""Fill-in-middle, personal data and the Merkle manifest against plain one-machine models."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from paceline.llm import fill_middle, merkle, personal_data

SF = "/root/testdata/sf0.001"
SCHEMA = "id bigint, notes string"
TEXTS = [
    None, "", "x", "plain words only", "größe 語 🙂 é\nline\ttwo", "has <P> mark", "<S", "<M>", "🙂" * 50, "a" * 2000,
    "semi <<P <S M> ends <", "ab1cd2" * 400, " ", "\n\n",
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- fill-in-middle


def plain_fim(text, record_id, seed=1, unit="token"):
    text = text or ""
    parts = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S) if unit == "token" else list(text)
    digest = sha(f"{seed}:{'' if record_id is None else record_id}")
    h = [int(digest[k:k + 8], 16) for k in range(0, 32, 8)]
    n = len(parts)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", ["token", "char"])
def test_fill_in_middle(spark, unit):
    rows = [(None if i == 70 else i, TEXTS[i % len(TEXTS)]) for i in range(120)] + [(5, "twice"), (5, "twice")]
    alerts = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit("clash")).withColumn("form", F.lit("clash"))
    out = fill_middle.fill_in_middle(alerts, unit=unit)
    back = out.withColumn("back", fill_middle.unfilled(F.col("filled"), F.col("form"))).collect()
    got = sorted(((r["id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["filled"]) for r in back), key=str)
    assert got == sorted(((i, *plain_fim(t, i, 1, unit)) for i, t in rows), key=str)
    assert sorted((str(r["id"]), r["back"]) for r in back) == sorted((str(i), t or "") for i, t in rows)
    assert {r["form"] for r in back} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(alerts.limit(0)).count() == 0


def test_wide_index_goes_both_ways():
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice("ab é語🙂\n") for _ in range(rng.randrange(0, 80)))
        index = fill_middle.WideIndex(np.frombuffer(text.encode(), np.uint8))
        points = np.arange(len(text) + 1)
        places = np.array([len(text[:k].encode()) for k in points])
        assert (index.to_bytes(points) == places).all() and (index.to_points(places) == points).all()
        assert len(index.bytes) == sum(len(c.encode()) > 1 for c in text)


def test_fill_in_middle_of_a_long_note():
    text = ("word 語 " * 300_000).encode()
    n, form, chars, out = fill_middle.rewrite(text, 1, 1, "token")
    assert (n, form, *chars, out.decode()) == plain_fim(text.decode(), 1)


# ---- personal data


def plain_base(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0

    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
              if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
              if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return found


def test_base_spans_of_random_texts():
    rng = random.Random(5)
    pieces = ["4111 1111 1111 1111", "10.0.0.255", "256.1.1.1", "a@b.c", "@", ".", "-", "+", "1", "23", "  ", " ", "é", "語",
              "x", "(030)", "+49 30 1234567", "AB", "%", "a.b@c-d.e.f", "007", "\n", "378282246310005", "0"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 24)))
        base = [(s.kind, s.start, s.end) for s in personal_data.find_spans(text) if s.kind in personal_data.BASE]
        assert base == plain_base(text), text


def test_checksums_and_words_around():
    def found(text):
        return [(s.kind, text[s.start:s.end], s.score) for s in personal_data.find_spans(text)]

    assert found("IBAN DE89 3704 0044 0532 0130 00 of") == [("iban", "DE89 3704 0044 0532 0130 00", 1.0)]
    assert found("x GB82WEST12345698765432.") == [("iban", "GB82WEST12345698765432", 0.8)]
    assert found("order GB82WEST12345698765432.") == []  # a word against it
    assert found("IBAN DE89 3704 0044 0532 0130 01") == []  # the sum does not fit
    assert found("Tel. (030) 123 4567") == [("number", "(030) 123 4567", 0.6)]
    assert found("about (030) 123 4567") == [] and found("version 10.0.0.1")[0][2] == 0.3
    assert found("his card 4111111111111111")[0] == ("card", "4111111111111111", 1.0)
    assert found("4111111111111112") == [] and personal_data.luhn("79927398713") and not personal_data.luhn("79927398710")


def test_scan_takes_time_linear_in_a_note():
    for text in ("a" * 200_000, "1" * 200_000, "+1" * 100_000, "1.1.1 " * 40_000, "a.b@" * 60_000, "AB12 " * 50_000, "+" + "(" * 200_000):
        personal_data.find_spans(text)


def test_personal_data_query(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in entry.queries()["op12_personal_data"](spark, SF).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        base = [f"{k}:{a}:{b}" for k, a, b in plain_base(text)]
        assert got[i]["base_sha256"] == sha(",".join(base)) and set(base) <= set(got[i]["spans"].split(",")) | {""}
        assert [got[i][f"n_{k}"] for k in personal_data.BASE] == [sum(b.startswith(k) for b in base) for k in personal_data.BASE]


def test_personal_data_edges(spark):
    alerts = spark.createDataFrame(
        [(1, None), (2, ""), (3, "a@b.cd"), (3, "a@b.cd"), (None, "+49 30 1234567 é a@b.cd")], SCHEMA).withColumn("spans", F.lit("clash"))
    got = sorted(((r["id"], r["n_email"], r["n_phone"], len(r["spans"])) for r in personal_data.scan_personal_data(alerts).collect()), key=str)
    assert got == sorted([(1, 0, 0, 0), (2, 0, 0, 0), (3, 1, 0, 1), (3, 1, 0, 1), (None, 1, 1, 2)], key=str)
    assert personal_data.scan_personal_data(alerts.limit(0)).count() == 0


# ---- Merkle manifest

LOG = "id bigint, stream_id string, zone_id string, density_count bigint, notes string"


def item(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(leaves):
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[k:k + 3])) for k in range(0, len(now), 3)])
    return levels


def plain_proof(levels, place):
    steps = []
    for level in levels[:-1]:
        first = place // 3 * 3
        steps.append(("".join(level[first:place]), "".join(level[place + 1:first + 3])))
        place //= 3
    return steps


def plain_manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, sha("".join(map(item, r))), r))
    names = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(by[g], key=lambda x: x[:3])]) for g in names}
    top = plain_tree([trees[g][-1][0] for g in names])
    out = []
    for rank, g in enumerate(names):
        for place, x in enumerate(sorted(by[g], key=lambda x: x[:3])):
            proof = plain_proof(trees[g], place) + plain_proof(top, rank)
            out.append((x[3][0], g, x[2], trees[g][-1][0], top[-1][0], tuple(proof)))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest(spark, levels):
    rng = random.Random(levels)
    sizes = {None: 2, "": 1, "cam0": 130, "cam1": 9, "cäm": 4, "cam2": 28, "z": 1}
    rows = [(rng.randrange(10 ** 6), g, rng.choice(["a", None]), rng.choice([3, None]), rng.choice([None, "", "n\né" * 4]))
            for g, n in sizes.items() for _ in range(n)]
    rows += [rows[20]] * 3 + [(None, "cam0", None, None, None), (rows[20][0], "cam0", "other", 1, "same id")]
    log = spark.createDataFrame(rows, LOG).withColumn("leaf", F.lit("clash"))
    out = merkle.manifest_proofs(log, levels=levels)
    got = out.withColumn("folded", merkle.fold(F.col("leaf"), F.col("proof"))).collect()
    assert all(r["folded"] == r["root"] for r in got)
    assert sorted(((r["id"], r["stream_id"], r["leaf"], r["subroot"], r["root"], tuple(map(tuple, r["proof"]))) for r in got),
                  key=str) == plain_manifest(rows)
    assert merkle.manifest_proofs(log.limit(0), levels=levels).count() == 0


def test_one_record(spark):
    log = spark.createDataFrame([(7, "cam0", "a", 3, "x")], LOG)
    r = merkle.manifest_proofs(log).first()
    assert r["leaf"] == r["subroot"] == r["root"] == sha("1:74:cam01:a1:31:x") and r["proof"] == []


def test_missing_nodes_are_enough_and_no_more():
    rng = random.Random(1)
    for _ in range(200):
        size = rng.randrange(1, 90)
        places = np.array(sorted(rng.sample(range(size), rng.randrange(1, size + 1))))
        levels = plain_tree([sha(str(k)) for k in range(size)])
        lacking = merkle.missing_nodes(places, size)
        fetched = {level: {int(p): levels[level][p] for p in at} for level, at in lacking}
        steps, top = merkle._derive({int(p): levels[0][p] for p in places}, fetched, size)
        proofs = merkle._expand(steps, [])
        assert top == levels[-1][0] and all(proofs[p] == plain_proof(levels, p) for p in map(int, places))
        # what can be derived, or is beside no leaf's path, is not asked for
        paths = [{p // 3 ** level for p in map(int, places)} for level in range(len(levels))]
        want = {(level, p) for level in range(len(levels) - 1) for p in range(len(levels[level]))
                if p not in paths[level] and p // 3 in paths[level + 1]}
        assert {(level, int(p)) for level, at in lacking for p in at} == want


def test_tampering_shows(spark):
    got = entry.queries()["op13_merkle_manifest"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in got:
        changed = zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and "\n" in (texts[r["doc_id"]] or "")
        assert r["verified"] == (not changed) == (r["folded_root"] == r["root"])
    assert {r["verified"] for r in got} == {True, False}
