"""Every registered operator query on the smallest tables, and its SQL where it has one."""

import hashlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from tabulon.llm import queries as Q

TABLES = ("documents", "embeddings", "pages", "conversations", "benchmark")


@pytest.fixture(scope="module")
def made(spark, sf):
    return {name: query(spark, sf).toPandas() for name, query in Q.QUERIES.items()}


@pytest.fixture(scope="module")
def tables(sf):
    return {t: duckdb.sql(f"SELECT * FROM '{sf}/{t}.parquet'").df() for t in TABLES}


def rows(df, columns):
    """Rows as texts, however either side holds nulls and whole numbers."""
    text = lambda v: "null" if v is None or v is pd.NA or v != v else str(int(v)) if isinstance(v, (int, float)) and v == int(v) else str(v)
    return Counter(tuple(text(v) for v in r) for r in df[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_its_sql(made, sf, name):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want, got = connection.execute(Q.ORACLE_SQL[name]).df(), made[name]
    assert sorted(want.columns) == sorted(got.columns) and len(want) == len(got) > 0
    columns = sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_each_document_gets_its_row(made, tables):
    ids = sorted(tables["documents"]["doc_id"])
    for name in ("op2_fingerprints", "op4_language_id", "op6_substring_dedup", "op7_sentencepiece", "op9_jaccard_join"):
        assert sorted(made[name]["doc_id"]) == ids, name
    assert set(made["op3_token_counts"]["doc_id"]) == set(ids)
    assert sorted(made["op12_importance_resampling"]["doc_id"]) == ids
    assert sorted(made["op8_html_extract"]["page_id"]) == sorted(tables["pages"]["page_id"])
    assert sorted(made["op10_embedding_dedup"]["vec_id"]) == sorted(tables["embeddings"]["vec_id"])


def test_conversations_read_back_and_one_is_added(made, tables):
    got = made["op5_chat_format"].set_index("conv_id")
    rows = tables["conversations"].sort_values(["conv_id", "turn"])
    for key, own in rows.groupby("conv_id"):
        turns = "".join(f"{r}\n{t or ''}\n" for r, t in zip(own["role"], own["text"], strict=True))
        assert got.loc[key, "turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest() and got.loc[key, "n_turns"] == len(own)
        loss = "".join(t or "" for r, t in zip(own["role"], own["text"], strict=True) if r == "assistant")
        assert got.loc[key, "loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and got.loc[key, "loss_chars"] == len(loss)
    said = "</s>[INST] ok [/INST]"
    assert got.loc[-7, "loss_sha256"] == hashlib.sha256(said.encode()).hexdigest() and len(got) == rows["conv_id"].nunique() + 1


def test_pieces_decode_to_the_text(made):
    assert (made["op7_sentencepiece"]["text_sha256"] == made["op7_sentencepiece"]["decoded_sha256"]).all()


def test_neighbours_have_the_recall(made, tables):
    rows = tables["embeddings"]
    x, ids = np.stack(rows["embedding"]).astype(float), rows["vec_id"].to_numpy()
    got, hits = made["op11_neighbour_search"], 0
    asked = [i for i in ids if i % 20 == 0]
    assert sorted(set(got["query_id"])) == sorted(asked) and len(got) == 20 * len(asked)
    for q, own in got.groupby("query_id"):
        near = sorted(zip(-(x @ x[ids == q][0]), ids, strict=True))
        hits += len({i for _, i in near if i != q} & set(own["vec_id"]) & {i for _, i in [p for p in near if p[1] != q][:20]})
    assert hits >= 0.98 * 20 * len(asked)
