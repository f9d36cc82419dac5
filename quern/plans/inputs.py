"""Input tables of the registered queries: the given tables, and texts built from them by SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: A question an order.
QUERY_LOG = """
select o_orderkey as query_id, o_orderdate as ts,
       case o_orderkey % 16
         when 0 then 'How to improve customer service in ' || n_name || '?'
         when 1 then 'Compare revenue of ' || n_name || ' and profit last quarter, and analyze trends'
         when 2 then 'What is the current status of order ' || cast(o_orderkey as string) || '?'
         when 3 then 'Why did sales drop in ' || n_name || ' since 1998? Explain the reason and impact'
         when 4 then 'Define KPI and ROI for "' || c_mktsegment || ' segment"'
         when 5 then 'Explore research on employee training, hiring and performance review'
         when 6 then 'Should I choose the API or the database for the ' || lower(c_mktsegment) || ' system?'
         when 7 then 'Steps to fix the issue with the workflow process in Q3 2024'
         when 8 then 'Who is the marketing manager for Acme ' || n_name || '?'
         when 9 then 'Plan for next year: strategy, roadmap and budget if cost rises'
         when 10 then 'Evaluate contract compliance, policy and regulation'
         when 11 then 'Show recent data on patient treatment and clinical diagnosis'
         when 12 then 'Optimize inventory and logistics performance, reduce cost'
         when 13 then 'Student course assessment results'
         when 14 then 'customer ' || c_name
         else 'zzz' end as text
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
"""

#: One business note a supplier.
NOTES = """
select s_suppkey as doc_id,
       'Acme ' || n_name || ' Corp reported $' || cast(1000 + s_suppkey * 7 as string) || '.00 in revenue on 1998-0' || cast(1 + s_suppkey % 9 as string) || '-15. '
       || case s_suppkey % 5
            when 0 then 'This is important because growth of ' || cast(s_suppkey % 40 as string) || '% shows a significant margin. '
            when 1 then 'See the report on efficiency! The key result indicates what Dr Jane Smith proves. '
            when 2 then 'Sales came after the previous quarter. Short one. '
            when 3 then 'The unit is part of ' || r_name || ' and never changed? It is a long sentence that goes on about logistics, procurement, and inventory for the whole division without an end in sight, so that it passes the two hundred character mark which the scoring of key points treats as too long for a point of use. '
            else 'Nothing else was said about the matter at hand today. ' end
       || 'Contact ' || s_name || ' at Department of Trade.' as text,
       'Note ' || cast(s_suppkey as string) as title, lower(r_name) as source, timestamp '1998-01-01 00:00:00' + s_suppkey * interval '1 day' as created_at
from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
"""

#: Questions with an answer and two sources, one an order.
INTERACTIONS = """
select o_orderkey as id, o_orderdate + (o_orderkey % 1440) * interval '1 minute' as ts, o_orderkey % 9 as n,
       case o_orderkey % 4 when 0 then 'What is the revenue of ' || n_name || '?' when 1 then 'Why did orders rise in ' || n_name || '?'
                           when 2 then 'How does the process of ' || c_mktsegment || ' work?' else 'order ' || cast(o_orderkey as string) end as query,
       case o_orderkey % 7
         when 0 then 'According to the document, revenue of ' || n_name || ' is ' || cast(o_custkey as string) || ' because of ' || c_mktsegment || '. However, this may be too low.'
         when 1 then 'It is definitely ' || cast(o_orderkey as string) || '. All of it was never true.'
         when 2 then 'No.'
         when 3 then 'The text states that orders of ' || c_name || ' are ' || cast(o_custkey as string) || '. Therefore the process is based on ' || n_name || '. Thus it suggests that Acme Widgets grew by 12.5%.'
         when 4 then ''
         when 5 then 'Specifically, exactly ' || cast(o_orderkey % 50 as string) || ' orders, in fact all of them, certainly came from Nowhere Land through the method'
         else c_mktsegment || ' of ' || n_name || ' is not incorrect. It appears to be always so. For example, see ' || c_name || '. Also note the rest.' end as response,
       case when o_orderkey % 11 = 0 then cast(null as string) else 'Revenue of ' || n_name || ' is ' || cast(o_custkey as string) || ' in the ' || c_mktsegment || ' segment, which is true and correct.' end as doc1,
       case when o_orderkey % 11 = 0 then cast(null as string) else 'Orders of ' || c_name || ' are always ' || cast(o_orderkey % 50 as string) || ' and the process is known.' end as doc2,
       cast(c_acctbal as double) as balance
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
"""

DERIVED = {"query_log": QUERY_LOG, "notes": NOTES, "interactions": INTERACTIONS}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a derived one."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = DERIVED[name]
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            read(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(text)


def sql(text: str) -> str:
    """An oracle with the derived tables it names in front, as DuckDB reads them."""
    used = [n for n in DERIVED if re.search(rf"\b{n}\b", text)]
    views = ", ".join(f"{n} as ({DERIVED[n].replace(' as string)', ' as varchar)')})" for n in used)
    if not used:
        return text
    body = text.strip()
    return f"with recursive {views}, {body[len('with recursive ') :] if body.startswith('with recursive ') else body[5:]}" if body.startswith("with ") else f"with {views} {body}"
