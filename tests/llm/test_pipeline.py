"""The pipeline's stages, each on what the one before kept, against SQL or brute force on a small fixture."""

import random
import re

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from ramus.llm import oracles
from ramus.llm.near_dedup import close
from ramus.llm.sentencepiece_codec import encode, load

corpus_pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def fixture():
    r = random.Random(11)
    words = [f"{a}{b}{c}" for a in ("ta", "ri", "mo", "se") for b in ("ne", "lo", "ki") for c in ("", "r", "s", "nt")]
    prose = lambda n: [r.choice(words) for _ in range(n)]
    item, passage = prose(30), prose(70)
    made = [prose(r.randint(55, 200)) for _ in range(24)]
    for i in (1, 2, 3):
        made[i] = list(made[0])
    for i in (5, 6):
        made[i] = list(made[4])
        for k in r.sample(range(len(made[4])), len(made[4]) // 12):
            made[i][k] = "edited"
    for i in (8, 9, 10):
        made[i] = made[i][:40] + passage + made[i][40:]
    for i in (12, 13):
        made[i] = made[i][:30] + item[3:25] + made[i][30:]
    made += [prose(10), ["same"] * 80, [], prose(60)]
    texts = [" ".join(m) for m in made] + [None, "x\n" * 5 + " ".join(prose(80)), " | ".join(prose(90))]
    rows = [(100 - i, t, "en" if i % 3 else None, "s" if i % 2 else "t", len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[20], rows[0]], [(1, " ".join(item)), (2, "ends"), (3, None)]


def words_of(frame):
    return [SPACE.findall(t or "") for t in frame["text"]]


def by_sql(sql, frame, items, where):
    con = duckdb.connect()
    con.register("documents", frame.assign(doc_id=np.arange(len(frame))))
    con.register("benchmark", items)
    keep = {r[0] for r in con.execute(f"SELECT doc_id FROM ({sql}) WHERE {where}").fetchall()}
    return frame[[i in keep for i in range(len(frame))]].reset_index(drop=True)


def first_of_classes(frame):
    words = words_of(frame)
    number = {w: k for k, w in enumerate(sorted({w for x in words for w in x}))}
    ids, root = [np.array([number[w] for w in x], int) for x in words], list(range(len(frame)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if frame["text"][i] == frame["text"][j] or len(ids[i]) and len(ids[j]) and close(ids[i], ids[j], 0.8):
                root[top(i)] = top(j)
    group = pd.Series([top(i) for i in range(len(ids))])
    least = frame["doc_id"].groupby(group).transform("min")
    return frame[frame["doc_id"] == least].drop_duplicates("doc_id").reset_index(drop=True)


def without_repeats(frame):
    words, first, out = words_of(frame), {}, frame.copy()
    for i, w in zip(frame["doc_id"], words):
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, i), i)
    for n, (i, w) in enumerate(zip(frame["doc_id"], words)):
        gone = {k + d for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for d in range(13)}
        if gone:
            out.loc[n, "text"] = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.loc[n, "n_chars"] = len(out["text"][n])
    return out


def bag(frame):
    return sorted(map(tuple, frame[COLUMNS].astype(object).where(frame[COLUMNS].notna(), None).to_numpy().tolist()), key=repr)


def test_stages_and_run(spark, tmp_path):
    rows, items = fixture()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want, bench = pd.DataFrame(rows, columns=COLUMNS), pd.DataFrame(items, columns=["item_id", "text"])
    brute = [lambda f: by_sql(oracles.OP8, f, bench, "kept"), first_of_classes, without_repeats, lambda f: by_sql(oracles.OP4, f, bench, "NOT contaminated")]
    sizes = [len(want)]
    for (name, stage), check in zip(corpus_pipeline.STAGES, brute):
        docs = spark.createDataFrame(want.astype(object).where(want.notna(), None), "doc_id long, text string, lang string, source string, n_chars long")
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == COLUMNS, name
        want = check(want)
        assert bag(got.toPandas()) == bag(want), name
        sizes.append(len(want))
    # Each stage but the third, which cuts passages, has dropped something.
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] > sizes[4] > 0
    model = load(public_tokenizers.path("piece_bpe_32k.model"))
    ids, at = encode(pa.array(want["text"]), model)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {i: r.ids for i, r in got.items()} == {i: ids[a:b].tolist() for i, a, b in zip(want["doc_id"], at[:-1], at[1:])}
    assert all(r.round_trip for r in got.values())


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
