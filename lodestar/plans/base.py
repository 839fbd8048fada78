"""Record, answer and pair tables derived from the common tables by expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.functions import vocabulary as V


def pick(number: str, values: list[str | None]) -> str:
    """SQL: the value at a number modulo the length of the list."""
    text = lambda v: "NULL" if v is None else "'" + v + "'"
    return f"CASE ({number}) % {len(values)} " + " ".join(f"WHEN {i} THEN {text(v)}" for i, v in enumerate(values)) + " END"


_D_REF = pick("doc_id", ["东", "东北方向", "正南", "西南", "北偏东", "西", "东南", "北", "南偏西"])
_D_PRE = pick("doc_id * 5 + n_chars", ["东", "东北", "南方", "西偏南", "东北", "正西", "不清楚", "北"])
_T_REF = pick("doc_id", ["相邻", "不相邻", "包含", "位于省境内", "境内有湖泊", "部分重叠", "属于该省"])
_T_PRE = pick("doc_id * 3 + n_chars", ["两者相邻", "分离", "包含", "内部", "交叉", "接壤", "说不清"])
_M_REF = "concat('约', n_chars % 2000, '公里')"
_M_PRE = f"concat('距离', n_chars % 2000 + (doc_id % 9) * 40, {pick('doc_id', ['公里', '千米', ' km', '米'])})"
_KIND = pick("doc_id", V.RELATIONS)
_LEVEL = pick("doc_id", ["easy", "medium", "hard"])

#: name: (source table, {column: expression})
DERIVED = {
    "answers": (
        "documents",
        {
            "id": "doc_id", "spatial_type": _KIND, "difficulty": _LEVEL, "model": pick("n_chars", ["m1", "m2", "m3"]),
            "reference": f"CASE doc_id % 4 WHEN 0 THEN {_D_REF} WHEN 1 THEN {_T_REF} WHEN 2 THEN {_M_REF} ELSE concat({_D_REF}, '，', {_M_REF}) END",
            "prediction": f"CASE WHEN doc_id % 13 = 0 THEN 'ERROR: timeout' WHEN doc_id % 4 = 0 THEN {_D_PRE} WHEN doc_id % 4 = 1 THEN {_T_PRE} WHEN doc_id % 4 = 2 THEN {_M_PRE} ELSE concat({_D_PRE}, '，', {_M_PRE}) END",
            "other": f"CASE doc_id % 4 WHEN 0 THEN {_D_REF} WHEN 1 THEN {_T_PRE} WHEN 2 THEN {_M_REF} ELSE concat({_D_PRE}, '，', {_M_REF}) END",
        },
    ),
    "records": (
        "documents",
        {
            "id": "doc_id", "relation": f"CASE WHEN doc_id % 17 = 0 THEN NULL ELSE {_KIND} END", "subtype": pick("doc_id", [*V.TOPOLOGY, "touch", "Inside ", None]),
            "question": "concat(" + pick("doc_id", ["请判断", "请问", "从拓扑关系来看，", "已知甲位于北纬30.5度，", ""]) + ", '城市', doc_id % 90, '与城市', n_chars % 90, " + pick("n_chars", ["是否相邻？", "之间的距离是多少？", "在什么方向？", "的关系如何？"]) + ")",
            "answer": f"concat({_T_REF}, '，', {_M_REF})", "difficulty": _LEVEL, "score": "CAST(10 + doc_id % 41 AS DOUBLE) / 10", "prompt_id": "source", "length": "n_chars",
            "n_entities": "CAST(1 + doc_id % 4 AS INT)", "name1": "concat('城市', doc_id % 90)", "name2": "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE concat('城市', n_chars % 90) END",
            "type1": pick("doc_id", ["city", "province", "river", "town", "landmark"]), "type2": pick("n_chars", ["city", "landmark", "country", "park"]),
            "lon1": "70 + CAST(doc_id * 37 % 700 AS DOUBLE) / 10", "lat1": "15 + CAST(doc_id * 53 % 420 AS DOUBLE) / 10",
            "lon2": "70 + CAST(n_chars * 31 % 700 AS DOUBLE) / 10", "lat2": "15 + CAST(n_chars * 59 % 420 AS DOUBLE) / 10",
        },
    ),
    "pairs": (
        "lineitem",
        {
            "pair_id": "concat(" + pick("l_linenumber", ["topo", "dir", "met"]) + ", '_x_', l_orderkey % 1500)",
            "relation": pick("l_linenumber", ["geo.contains", "geo.touches", "geo.metric", "geo.direction", "geo.direction_distance", "geo.intersects", "geo.disjoint"]),
            "a": "l_partkey % 300", "b": "l_suppkey * 7 % 300", "negative": "l_orderkey % 9 = 0",
            "a_type": pick("l_partkey", ["city", "province", "river", "lake"]), "b_type": pick("l_suppkey", ["city", "airport", "lake"]),
            "km": "CAST(floor(l_extendedprice * 0.05) AS BIGINT)", "azimuth": "CAST(l_partkey * 7 + l_orderkey * 13 + l_linenumber * 31 AS BIGINT) % 360",
            "a_lon": "73 + CAST((l_partkey % 300) * 37 % 620 AS DOUBLE) / 10", "a_lat": "18 + CAST((l_partkey % 300) * 53 % 360 AS DOUBLE) / 10",
            "b_lon": "73 + CAST((l_suppkey * 7 % 300) * 37 % 620 AS DOUBLE) / 10", "b_lat": "18 + CAST((l_suppkey * 7 % 300) * 53 % 360 AS DOUBLE) / 10",
        },
    ),
    "entities": (
        "customer",
        {
            "entity_id": "c_custkey", "name": "concat('E', c_custkey % 400)", "type": "c_mktsegment", "parent": "c_nationkey",
            "lon": "73 + CAST(c_custkey * 37 % 6200 AS DOUBLE) / 100", "lat": "18 + CAST(c_custkey * 53 % 3600 AS DOUBLE) / 100", "geom": "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'g' END",
        },
    ),
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A common table, or a table derived from one."""
    source, columns = DERIVED.get(name, (name, None))
    df = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    return df if columns is None else df.selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def sql(body: str, *names: str) -> str:
    """A query over derived tables as one statement."""
    made = [f"{n} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in DERIVED[n][1].items())} FROM {DERIVED[n][0]})" for n in names]
    extra = body.lstrip()
    if extra.upper().startswith("WITH "):
        return "WITH " + ", ".join(made) + ", " + extra[5:]
    return "WITH " + ", ".join(made) + " " + extra
