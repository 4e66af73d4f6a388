"""Queries of preset files, closures and leaves of any depth, and bounded fits with weights and noise."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import inversion as I
from ..operators import space as S
from ..session import cut, delete_folder, new_folder
from ..sources import documents as D
from ..sources import preset_files
from .tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes, sha1(coalesce(text, '')) AS digest FROM documents")
def preset_files_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a file of its own, written and read back."""
    preset_files.register(spark)
    folder = new_folder(spark, "presets")
    name = F.format_string("%d/%d.preset", F.col("doc_id") % 64, F.col("doc_id"))
    table(spark, sf, "documents").select(name.alias("name"), F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")).alias("content")).write.format("presets").mode("append").save(folder)
    back = spark.read.format("presets").load(folder)
    doc_id = F.regexp_extract("name", r"(-?\d+)\.preset$", 1).cast("long")
    out = cut(back.select(doc_id.alias("doc_id"), F.octet_length("content").cast("long").alias("bytes"), F.sha1("content").alias("digest")))
    delete_folder(spark, folder)
    return out


_PARENT = "CASE WHEN p_partkey % 50 != 0 THEN p_partkey - 1 WHEN p_partkey % 150 = 0 THEN p_partkey + 49 END"


@query(
    f"""WITH RECURSIVE l AS (SELECT p_partkey AS c, {_PARENT} AS p FROM part WHERE {_PARENT} IS NOT NULL),
r AS (SELECT c AS node, p AS ancestor, 1 AS steps FROM l UNION ALL SELECT node, p, steps + 1 FROM r JOIN l ON c = ancestor WHERE p != node) SELECT * FROM r"""
)
def gate_closure(spark: SparkSession, sf: str) -> DataFrame:
    """All gates above each part: chains of fifty, and every third a ring."""
    links = table(spark, sf, "part").select(F.col("p_partkey").alias("child"), F.expr(_PARENT).alias("parent")).filter("parent is not null")
    return S.ancestors(links, "child", "parent")


_NESTED = """concat(repeat('{"k": ', CAST(o_orderkey % 6 AS INT)), '{"n": ', o_orderkey, ', "f": ', CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END, ', "t": "', o_orderkey, '", "list": [', o_custkey, ', {"m": -', o_custkey, '.5}, null]}', repeat(', "e": {}}', CAST(o_orderkey % 6 AS INT)))"""


@query(
    f"""SELECT o_orderkey, regexp_replace(replace(replace(fullkey[3:], '[', '/'), ']', ''), '[.]', '/', 'g') AS path, CAST(atom AS DOUBLE) AS value
FROM (SELECT o_orderkey, {_NESTED} AS doc FROM orders), json_tree(doc) WHERE type IN ('UBIGINT', 'BIGINT', 'DOUBLE')"""
)
def numeric_leaves(spark: SparkSession, sf: str) -> DataFrame:
    """The numbers of a nested document for each order, up to eight levels deep."""
    return D.numeric_leaves(table(spark, sf, "orders").select("o_orderkey", F.expr(_NESTED).alias("json")), "o_orderkey")


_HZ = [20 * 2 ** (k / 6) for k in range(64)]
_BASIS = I.bell_basis(_HZ, [180.0, 2200.0])
_W = np.where((np.array(_HZ) >= I.FULL_HZ[0]) & (np.array(_HZ) <= I.FULL_HZ[1]), 1.0, I.OUTSIDE)
_A = _BASIS * _W[:, None]
_G = (_A.T @ _A).tolist()
_LOW, _HIGH, _NOISE = -3.0, 2.5, 1.2


def _list(x: np.ndarray) -> str:
    return f"[{', '.join(map(repr, map(float, x)))}]::DOUBLE[]"


def _held(x: str) -> str:
    return f"least(greatest({x}, {_LOW}), {_HIGH})"


_EDGES = " UNION ALL ".join(
    [f"SELECT vec_id, c1, c2, {e} AS x1, {_held(f'(c2 - {_G[0][1]!r} * {e}) / {_G[1][1]!r}')} AS x2 FROM c" for e in (_LOW, _HIGH)]
    + [f"SELECT vec_id, c1, c2, {_held(f'(c1 - {_G[0][1]!r} * {e}) / {_G[0][0]!r}')} AS x1, {e} AS x2 FROM c" for e in (_LOW, _HIGH)]
)
_DET = float(_G[0][0] * _G[1][1] - _G[0][1] ** 2)
_FULL = _BASIS[(np.array(_HZ) >= I.FULL_HZ[0]) & (np.array(_HZ) <= I.FULL_HZ[1])]


@query(
    f"""WITH e AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: 20 * x) AS curve FROM embeddings), c AS (SELECT vec_id, list_inner_product(curve, {_list(_A[:, 0] * _W)}) AS c1, list_inner_product(curve, {_list(_A[:, 1] * _W)}) AS c2 FROM e),
i AS (SELECT vec_id, c1, c2, (c1 * {_G[1][1]!r} - c2 * {_G[0][1]!r}) / {_DET!r} AS x1, (c2 * {_G[0][0]!r} - c1 * {_G[0][1]!r}) / {_DET!r} AS x2 FROM c), a AS (SELECT * FROM i WHERE x1 BETWEEN {_LOW} AND {_HIGH} AND x2 BETWEEN {_LOW} AND {_HIGH} UNION ALL {_EDGES}),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY x1 * x1 * {_G[0][0]!r} + 2 * x1 * x2 * {_G[0][1]!r} + x2 * x2 * {_G[1][1]!r} - 2 * (c1 * x1 + c2 * x2)) = 1),
r AS (SELECT vec_id, round(x1, 2) AS g1, round(x2, 2) AS g2 FROM b), m AS (SELECT *, list_max(list_transform(list_zip({_list(_FULL[:, 0])}, {_list(_FULL[:, 1])}), lambda z: abs(g1 * z[1] + g2 * z[2]))) > {_NOISE} AS stands FROM r)
SELECT vec_id, CASE WHEN stands THEN g1 ELSE 0 END AS g1, CASE WHEN stands THEN g2 ELSE 0 END AS g2, stands, true AS minimal FROM m"""
)
def weighted_band_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Two bounded bands fitted to every curve of 64 points, kept where they rise above the noise; SQL tries all edges."""
    curves = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: 20 * x.cast("double")).alias("curve"), F.array_repeat(F.lit(_NOISE), 64).alias("noise"))
    fits = I.weighted_fits(curves, "vec_id", _BASIS, _HZ, _LOW, _HIGH, "noise")
    return fits.select("vec_id", F.col("gains")[0].alias("g1"), F.col("gains")[1].alias("g2"), (F.col("margin") > 0).alias("stands"), (F.col("gap") < 1e-6).alias("minimal"))
