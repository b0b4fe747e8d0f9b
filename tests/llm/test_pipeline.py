"""The pipeline against a brute-force version of each stage, on what the stage before it kept."""

from __future__ import annotations

import base64
import hashlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from tracemill.llm import quality_rules
from tracemill.llm.common import DOCUMENTS

from .test_ops import brute_components, sentence


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(45):
        text = sentence(300 + i, int(rng.integers(60, 140)))
        if i % 3 == 0:
            text = "The license line of all\n" + text
        rows.append((i, text, "en", ["a", "b", None][i % 3], len(text)))
    changed = rows[4][1].split()
    changed[30] = "new"
    rows += [(100, rows[4][1], "en", "b", None), (101, " ".join(changed), None, "a", 1), (102, None, None, None, None), (103, "", "en", "a", 0), (104, "too short", "en", "a", 9), (105, "# " * 200, "en", "b", 400), (106, "a b c " * 60, "en", "b", 1), (100, rows[4][1], "en", "b", 5)]
    path = tmp_path_factory.mktemp("sf")
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    pq.write_table(pa.table({n: pa.array([r[k] for r in rows], pa.string() if n in ("text", "lang", "source") else pa.int64()) for k, n in enumerate(names)}), path / "documents.parquet")
    return str(path), rows


def lines_of(texts):
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    seen = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    return ["\n".join(x for x in (t or "").split("\n") if not key(x) or seen[key(x)] < 10) for t in texts]


def mixed(rows):
    n_words = [len((r[1] or "").encode().split()) for r in rows]
    by = defaultdict(list)
    for i, r in enumerate(rows):
        by[r[3]].append((hashlib.md5(f"{r[0]}:mix".encode()).hexdigest(), r[0], n_words[i], i))
    total = {s: sum(x[2] for x in v) for s, v in by.items()}
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(by, key=lambda s: (s is None, s)))}
    capped: set = set()
    while True:
        rest = sum(total.values()) - sum(3 * total[s] for s in capped)
        free = sum(weight[s] for s in by if s not in capped)
        goal = {s: 3 * total[s] if s in capped else rest * weight[s] / free for s in by}
        if not (over := {s for s in by if goal[s] > 3 * total[s]}):
            break
        capped |= over
    out = []
    for s, v in by.items():
        at = 0
        for *_, n, i in sorted(v):
            for e in range(4):
                k = max(0, min(n, int(goal[s]) - (e * total[s] + at)))
                if k:
                    out.append((rows[i][0], s, rows[i][1] if k == n else k))
            at += n
    return out


def test_stages_against_brute_force(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = DOCUMENTS.fieldNames()
    kept = None
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r[c] for c in columns) for r in docs.collect()]
        out = stage(spark, docs, path)
        got = out.collect()
        if name == "quality rules":
            con = duckdb.connect()
            con.register("documents", docs.toArrow())
            good = {r[0] for r in con.execute(f"SELECT doc_id FROM ({quality_rules.ORACLE}) WHERE kept").fetchall()}
            assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows if r[0] in good) and {0, 4, 100, 101} <= good and len(good) > 30 and not good & {102, 103, 104, 105, 106}
        elif name == "line dedup":
            assert sorted((r.doc_id, r.text, r.n_chars) for r in got) == sorted((r[0], t, len(t)) for r, t in zip(before, lines_of([r[1] for r in before]), strict=True))
        elif name == "near dedup":
            ordered = sorted(before, key=lambda r: r[0])
            root = brute_components([r[1] for r in ordered], 5)
            assert sorted(r.doc_id for r in got) == [ordered[i][0] for i in range(len(ordered)) if root[i] == i]
            assert not {100, 101} & {r.doc_id for r in got}
        elif name == "mixing":
            want = mixed(before)
            words = lambda t: t.encode().split()
            texts = {(r[0], r[3]): r[1] for r in before}
            assert Counter((d, s, len(words(t)) if isinstance(t, str) else t) for d, s, t in want) == Counter((r.doc_id, r.source, len(words(r.text))) for r in got)
            assert all(texts[r.doc_id, r.source].strip().startswith(r.text.strip()) and r.n_chars == len(r.text) for r in got)
            kept = Counter((r.doc_id, r.text) for r in got)
        if name != "bpe":
            assert out.columns == columns
        docs = spark.createDataFrame(got, out.schema)
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert Counter((r.doc_id, enc.decode(r.ids)) for r in got) == kept
    assert all(r.n_tokens == len(r.ids) and r.ids == enc.encode_ordinary(enc.decode(r.ids)) and r.decoded_sha256 == hashlib.sha256(enc.decode_bytes(r.ids)).hexdigest() for r in got)
    whole = corpus_pipeline.run(spark, path).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in whole) == Counter((r.doc_id, tuple(r.ids)) for r in got)


def test_pipeline_over_no_documents(spark, tmp_path):
    spark.createDataFrame([], DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
