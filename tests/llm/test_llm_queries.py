"""Registered queries over whole given tables: against SQL, or against plain one-machine models."""

import glob
import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

import __spark_entry__ as entry
from paceline.llm import catalog
from test_llm_jaccard import plain_kept

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="module")
def docs(duck):
    return duck.execute("SELECT doc_id, coalesce(text, ''), source, lang FROM documents ORDER BY doc_id").fetchall()


def result(spark, name):
    return entry.queries()[name](spark, SF)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in data), key=str)


def test_registered():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql(spark, duck, name):
    df = result(spark, name)
    found = duck.execute(catalog.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, found.fetchall())


def plain_spans(text):
    word = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in (
        "password", "passwd", "secret", "token", "api_?key"))
    found = []
    for m in re.finditer(rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        found += [(m.start(), 0, f"assign:{m.start()}:{m.end()}")] * (len(m[2]) >= 6)
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}")
              for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [s[2] for s in sorted(found)]


def test_secret_scan(spark, docs):
    got = {r["doc_id"]: r for r in result(spark, "op2_secret_scan").collect()}
    assert len(got) == len(docs)
    for doc_id, text, *_ in docs:
        base, r = plain_spans(text), got[doc_id]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [
            sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")]
        assert set(base) <= set(r["spans"].split(",")) | {""}


def plain_fingerprint(text, words):
    low = text.translate({c: c + 32 for c in range(65, 91)})
    parts = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    shingles = [" ".join(parts[k:k + words]) for k in range(max(1, len(parts) - words + 1))] if parts else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if sum(h >> bit & 1 for h in hashes) * 2 > len(hashes))


def plain_groups(ids, fps, bits=3):
    fps, root = np.array(fps, np.uint64), list(range(len(ids)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(ids)):
        for b in np.flatnonzero(np.bitwise_count(fps ^ fps[a]) <= bits):
            x, y = find(a), find(int(b))
            root[max(x, y)] = min(x, y)
    return {i: ids[find(k)] for k, i in enumerate(ids)}


def test_simhash(spark, docs):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in result(spark, "op3_simhash_near_dedup").collect()}
    ids, fps = [d[0] for d in docs], [plain_fingerprint(d[1], 3) for d in docs]
    groups = plain_groups(ids, fps)
    assert got == {i: (f"{f:016x}", groups[i]) for i, f in zip(ids, fps, strict=True)}
    assert len(set(groups.values())) < len(ids)


@pytest.mark.parametrize("name, label, least", [("op4_toxicity", "toxic", 0.85), ("op6_quality", "quality", 0.85)])
def test_classifiers(spark, docs, duck, name, label, least):
    got = {r["doc_id"]: r for r in result(spark, name).collect()}
    assert set(got) == {d[0] for d in docs}
    held = {i for i in got if zlib.crc32(str(i).encode()) % 5 == 0}
    assert {i for i, r in got.items() if r["held_out"]} == held
    assert all(0 <= r["score"] <= 1 for r in got.values())
    truth = [(i, y) for i, y in duck.execute(f"SELECT doc_id, {label} FROM labels").fetchall()]
    right = [got[i]["predicted"] == y for i, y in truth]
    assert np.mean(right) >= least


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(catalog.tokenizer_path())
    want = {}
    for doc_id, text, *_ in docs:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        for k, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start:start + 2048]
            want[doc_id, k] = (start, len(part), zlib.crc32(part.tobytes()))
    got = result(spark, "op5_best_fit_packing").collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    sequences = {}
    for r in sorted(got, key=lambda r: r["offset"]):
        assert r["offset"] == sequences.get(r["sequence_id"], 0)
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    total = sum(r["length"] for r in got)
    assert max(sequences.values()) <= 2048 and len(sequences) <= -(-total // 2048) + 2


def test_pipeline_stages(spark, docs, duck):
    import corpus_pipeline
    from paceline.llm import toxicity

    tables = [spark.read.parquet(f"{SF}/documents.parquet")]
    from paceline.session import cut_lineage

    for _, stage in corpus_pipeline.STAGES:
        tables.append(cut_lineage(stage(spark, tables[-1], SF)))
    start, mild, lines, apart, mixed, packed = ({}, {}, {}, {}, [], [])
    start, mild, lines, apart = ({r["doc_id"]: r for r in t.collect()} for t in tables[:4])
    mixed, packed = tables[4].collect(), tables[5].collect()
    assert all(t.columns == tables[0].columns for t in tables[1:5])
    # toxicity: the model's decisions, made here row by row
    model = toxicity.fit_toxicity(catalog.as_alerts(tables[0]), catalog.training_labels(spark, SF))
    assert set(mild) == {i for i, r in start.items() if model.score(r["text"]) < 0.5}
    # lines
    keys = {}
    for i, r in mild.items():
        for line in (r["text"] or "").split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
            if len(key) >= 20:
                keys.setdefault(key, set()).add(i)
    for i, r in mild.items():
        left = []
        for line in (r["text"] or "").split("\n"):
            held = keys.get(line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)}), ())
            if len(held) < 3 or max(held) == i:
                left.append(line)
        assert lines[i]["text"] == "\n".join(left) and lines[i]["n_chars"] == len(lines[i]["text"])
    # near copies
    assert set(apart) == plain_kept({i: r["text"] for i, r in lines.items()}) and all(apart[i] == lines[i] for i in apart)
    assert len(apart) < len(lines)
    # mixing: rows repeat by a Poisson law at their own number
    sizes = {}
    for r in apart.values():
        sizes[r["source"]] = sizes.get(r["source"], 0) + 1
    share = {s: n ** 0.5 for s, n in sizes.items()}
    for i, r in apart.items():
        rate = len(apart) * share[r["source"]] / sum(share.values()) / sizes[r["source"]]
        u = int(hashlib.md5(f"42:{i}".encode()).hexdigest()[:13], 16) / 2 ** 52
        k, term = 0, np.exp(-rate)
        total = term
        while total <= u:
            k += 1
            term *= rate / k
            total += term
        assert sum(m["doc_id"] == i for m in mixed) == k
    # packing
    assert sorted({r["doc_id"] for r in packed}) == sorted({m["doc_id"] for m in mixed})
    assert sum(r["piece"] == 0 for r in packed) == len(mixed)
    ran = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, ran.drop("sequence_id", "offset").collect())) == sorted(
        map(tuple, tables[5].drop("sequence_id", "offset").collect()))


def test_swapped_terms_of_the_corpus(spark):
    """Terms found in the given documents are swapped in their sentences, and the penalty draws their weights together."""
    from paceline.llm import toxicity
    alerts = catalog.as_alerts(spark.read.parquet(f"{SF}/documents.parquet"))
    labels = catalog.training_labels(spark, SF)
    free, tied = (toxicity.fit_toxicity(alerts, labels, penalty=p) for p in (0.0, 10.0))
    pairs = tied.terms[len(toxicity.IDENTITY_TERMS):]
    assert free.terms == tied.terms and len(pairs) >= 5 and tied.swaps > 100
    assert len({t for pair in pairs for t in pair}) == 2 * len(pairs)
    gap = lambda m: sum(abs(m.weights.get(a, 0.0) - m.weights.get(b, 0.0)) for a, b in pairs)
    assert gap(tied) < 0.5 * gap(free)


def test_swaps_of_a_sentence():
    from paceline.llm import toxicity
    terms = (("women", "men"), ("red", "green", "blue"))
    got = sorted(sorted(t) for t in toxicity.swaps_of({"women", "like", "red"}, terms))
    assert got == [["blue", "like", "women"], ["green", "like", "women"], ["like", "men", "red"]]
    assert list(toxicity.swaps_of({"women", "and", "men"}, terms)) == []
