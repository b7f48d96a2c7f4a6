"""The pipeline's stages against brute force, each on what the one before kept."""

from __future__ import annotations

import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import tiktoken

from gristmill.llm import langid, queries

from .conftest import prose
from .test_dedup import ALNUM, UPPER, contamination, lines_by_hand, near_by_hand, sha
from .test_tokens import ranks


def full_windows(rows, span=13):
    words = [ALNUM.findall((t or "").translate(UPPER)) for _, t in rows]
    return {tuple(w[s : s + span]) for w in words for s in range(len(w) - span + 1)}


def test_a_window_in_a_long_document_goes(spark, sf, tmp_path):
    """13 words of an item in 5,000: far below a twentieth, and yet the window is gone from what stays."""
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    item = ALNUM.findall(bench[0][1].translate(UPPER))
    texts = {1: prose(2500, 1) + " " + " ".join(item[1:14]) + " " + prose(2500, 2), 2: prose(2500, 3) + " " + " ".join(item[1:13]) + " " + prose(2500, 4)}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)["benchmark"]
    kept = stage(spark, docs, sf).collect()
    assert [r["doc_id"] for r in kept] == [2]
    assert not any(full_windows([(r["doc_id"], r["text"])]) & full_windows(bench) for r in kept)


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(n)))
        after = spark.read.parquet(str(tmp_path / str(n)))
        if name != "encode":
            assert after.columns == columns
            got = {r["doc_id"]: r["text"] for r in after.collect()}
        if name == "language":
            model = langid.fit(docs.where(~langid.held_out()))
            lang, _, _ = langid.predict(model, pa.array([t or "" for t in before.values()], pa.large_string()))
            assert got == {i: t for (i, t), x in zip(before.items(), lang) if x != "und"}
            assert len(got) >= 0.9 * len(before)
        elif name == "lines":
            assert sorted((i, sha(t)) for i, t in got.items()) == [(r[0], r[3]) for r in sorted(lines_by_hand(sorted(before.items())))]
        elif name == "near":
            assert got == {i: before[i] for i, _, _, kept in near_by_hand(list(before.items()), 5, 80) if kept}
        elif name == "benchmark":
            windows = full_windows(bench)
            bad = {r[0] for r in contamination(list(before.items()), bench) if r[5]} | {i for i, t in before.items() if full_windows([(i, t)]) & windows}
            assert not any(full_windows([x]) & windows for x in got.items())
            assert bad and got == {i: t for i, t in before.items() if i not in bad}
        else:
            e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks(), special_tokens={})
            want = []
            for i, t in before.items():
                ids = e.encode_ordinary(t)
                want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(t)))
            assert sorted(map(tuple, after.collect())) == sorted(want)
        docs = after
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(want)


def test_registered():
    found = queries.queries()
    assert sorted(int(k[2:].split("_")[0]) for k in found) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(found)
