"""The inputs of the registered queries: chunks, a graph, code files, usage rows and events made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspark.operators.graph.store import Store
from loomspark.scratch import ready


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


CHUNK_COLUMNS = [
    "cast(doc_id as string) as id",
    "doc_id as pos",
    "concat(source, '/', doc_id, '.md') as path",
    "'markdown' as language",
    "coalesce(text, '') as content",
    "case doc_id % 5 when 0 then 'code' when 1 then 'comment' when 2 then 'doc' when 3 then 'diagnostic' else 'selection' end as kind",
    "cast(doc_id % 3 as int) as priority",
    "false as skeleton_hint",
    "cast(doc_id % 7 as int) as community",
]


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("doc_id is not null").selectExpr(*CHUNK_COLUMNS)


#: Ids of parts, customers, nations and regions start here; suppliers keep theirs.
PART, CUSTOMER, NATION, REGION = 10**9, 2 * 10**9, 3 * 10**9, 4 * 10**9


def graph(spark: SparkSession, sf_dir: str) -> Store:
    """Suppliers call the parts they ship, customers are contained in nations, nations import regions."""
    t = lambda n: table(spark, sf_dir, n)

    def node(df: DataFrame, key: str, base: int, kind: str, word: str) -> DataFrame:
        return df.selectExpr(f"{key} + {base}L as id", f"'{kind}' as kind", f"concat('{word}', {key}) as name", f"concat('{word}::', {key}) as qualified", f"concat('{word}/', {key} % 10) as path", "'python' as language", f"cast({key} % 100 as int) as start_line", "0 as end_line", f"concat('def {word}', {key}, '()') as signature", "0L as body_bytes")

    nodes = node(t("supplier"), "s_suppkey", 0, "function", "s").unionByName(node(t("part"), "p_partkey", PART, "function", "p")).unionByName(node(t("customer"), "c_custkey", CUSTOMER, "method", "c")).unionByName(node(t("nation"), "n_nationkey", NATION, "class", "n")).unionByName(node(t("region"), "r_regionkey", REGION, "import", "r"))
    calls = t("lineitem").selectExpr("l_suppkey as src", f"l_partkey + {PART}L as dst").distinct().selectExpr("src", "dst", "'calls' as kind", "0.7D as confidence")
    within = t("customer").selectExpr(f"c_nationkey + {NATION}L as src", f"c_custkey + {CUSTOMER}L as dst", "'contains' as kind", "1.0D as confidence")
    imports = t("nation").selectExpr(f"n_nationkey + {NATION}L as src", f"n_regionkey + {REGION}L as dst", "'imports' as kind", "1.0D as confidence")
    files = nodes.selectExpr("path").distinct().selectExpr("path", "sha2(path, 256) as sha256", "'python' as language", "0L as last_indexed")
    return Store(nodes, calls.unionByName(within).unionByName(imports), files)


#: Python sources made from the parts: a module for each size, with a function a part that calls the next part's.
CODE_COLUMNS = [
    "concat('pkg/m', p_size, '.py') as path",
    "'python' as language",
    "concat('import os\\nfrom pkg import m', p_size % 7, '\\n\\n\\nclass Base', p_size, ':\\n    def run(self):\\n        # note\\n        return f', p_size * 10 % 97, '(self)\\n\\n\\n', body) as content",
]


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, language, content)."""
    part = table(spark, sf_dir, "part").selectExpr("p_size", "p_partkey", "concat('def f', p_partkey, '(x):\\n    print(\"# x\")\\n    return f', p_partkey + 1, '(x)  # call\\n') as f")
    per = part.groupBy("p_size").agg({"f": "collect_list"}).selectExpr("p_size", "array_join(array_sort(`collect_list(f)`), '\\n\\n') as body")
    return per.selectExpr(*CODE_COLUMNS)


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A usage row for each event."""
    return table(spark, sf_dir, "events").selectExpr("event_id as ts", "cast(abs(value) * 100 as long) as in_tokens", "cast(abs(value) * 40 as long) as out_tokens", "cast(abs(value) * 100 as long) - cast(abs(value) * 40 as long) as saved_tokens", "cast(user_id % 50 as double) as elapsed_ms", "case when user_id % 9 = 0 then '  ' else event_type end as query", "1L as chunks_in", "1L as chunks_out", "'cli' as source", "case when user_id % 4 = 0 then null else concat('p', user_id % 3) end as project")
