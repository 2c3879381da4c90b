"""The same results in DuckDB SQL, over views named after the tables."""

from __future__ import annotations

TABLES = (
    "benchmark",
    "conversations",
    "customer",
    "documents",
    "embeddings",
    "events",
    "labels",
    "lineitem",
    "nation",
    "orders",
    "pages",
    "part",
    "region",
    "supplier",
)

_TOKENS = r"""
SELECT word FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS word FROM documents)
WHERE word <> ''
"""
_WORD_COUNT = f'SELECT word, count(*) AS "count" FROM ({_TOKENS}) GROUP BY word'
_GENERATED = """
SELECT o_orderkey AS id,
       CAST(('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT % 1000 + 1 AS INT) AS item_id,
       CAST((('0x' || substr(md5(o_orderkey::VARCHAR), 9, 8))::BIGINT % 999900 + 100)::DECIMAL(18, 0)
            / 100 AS DECIMAL(10, 2)) AS price
FROM orders
"""
_LATEST_EVENT = """
SELECT event_id, ts, user_id, event_type, value, props FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {order}) = 1
"""


def _counts(tables: tuple[str, ...] = TABLES, more: str = "") -> str:
    return " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, count(*) AS "rows"{more} FROM {t}""" for t in tables
    )


# Columns in order; those not named otherwise are written by a cast.
_COLUMNS = {
    "benchmark": "item_id text",
    "conversations": "conv_id turn role text",
    "customer": "c_custkey c_name c_nationkey c_acctbal:double c_mktsegment",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding:doubles label",
    "events": "event_id ts user_id event_type value:double props",
    "labels": "doc_id quality toxic",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity:double l_extendedprice:double "
    "l_discount:double l_tax:double l_returnflag l_linestatus l_shipdate",
    "nation": "n_nationkey n_name n_regionkey",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice:double o_orderdate o_orderpriority",
    "pages": "page_id url html",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice:double",
    "region": "r_regionkey r_name",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal:double",
}


def _told(column: str, text: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE length({text}) || ':' || {text} END"


def _hex(number: str) -> str:
    return f"replace(format('{{:a}}', {number}::DOUBLE), 'p+', 'p')"


def _written(column: str) -> str:
    name, _, kind = column.partition(":")
    if kind == "double":
        return _told(name, _hex(name))
    if kind == "doubles":
        return _told(name, f"array_to_string([{_told('x', _hex('x'))} FOR x IN {name}], '')")
    return _told(name, f"CAST({name} AS VARCHAR)")


def _fingerprint(table: str) -> str:
    """The sums of four pieces of the MD5 of every row's written columns."""
    row = " || ".join(f"({_written(c)})" for c in _COLUMNS[table].split())
    sums = " || '-' || ".join(
        f"CAST(coalesce(sum(('0x' || substr(h, {1 + 5 * i}, 5))::BIGINT), 0) AS VARCHAR)" for i in range(4)
    )
    return f"""
        SELECT '{table}' AS table_name, count(*) AS "rows", 'OK' AS status, {sums} AS fingerprint
        FROM (SELECT md5({row}) AS h FROM {table})"""


ORACLE_SQL: dict[str, str] = {
    "tokens": _TOKENS,
    "word_count": _WORD_COUNT,
    "top_words": f'{_WORD_COUNT} ORDER BY "count" DESC, word LIMIT 20',
    "distinct_words": f"SELECT count(DISTINCT word) AS n FROM ({_TOKENS})",
    "word_count_csv": _WORD_COUNT,
    "word_count_one_csv": f"SELECT *, 1 AS files FROM ({_WORD_COUNT})",
    "text_lines": "SELECT unnest(string_split(text, chr(10))) AS value FROM documents",
    "lines_from_values": """
        SELECT text AS value FROM documents UNION ALL
        SELECT * FROM (VALUES ('  leading blanks'), ('a' || chr(9) || 'tab'), (''),
                              ('two  blanks'), ('end '), ('the end')) v(value)""",
    "fetch_lines": """
        SELECT unnest(string_split(text, chr(10))) AS value FROM documents WHERE text IS NOT NULL""",
    "url_source": """
        SELECT unnest(string_split(text, chr(10))) AS value FROM documents WHERE text IS NOT NULL""",
    "demo_rows": """
        SELECT o_orderkey AS id, 'name_' || o_orderkey AS name, o_orderkey * 1.5::DOUBLE AS score
        FROM orders""",
    "datagen_batch": _GENERATED,
    "datagen_stream": f"SELECT *, true AS whole_ms FROM ({_GENERATED})",
    "cast_decimal": """
        SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(10, 2)) AS price
        FROM lineitem""",
    "like_or_filter": "SELECT * FROM part WHERE p_type LIKE '%A%' OR p_name LIKE '%a%'",
    "prefix_filter": """
        SELECT page_id, url FROM pages
        WHERE starts_with(trim(coalesce(url, '')), 'http://')
           OR starts_with(trim(coalesce(url, '')), 'https://m.')""",
    "save_table_readback": "SELECT * FROM orders",
    "ctas_parquet": "SELECT * FROM lineitem",
    "create_strict": "SELECT * FROM customer",
    "register_external": "SELECT event_id, ts, user_id, value, props, event_type FROM events",
    "new_partitions": """
        SELECT event_id, ts, user_id, value, props, event_type, CAST(1 AS INT) AS added FROM events""",
    "catalog_tables": _counts(),
    "show_tables": _counts(),
    "catalog_subset": f"""
        SELECT table_name, "rows", CAST(CASE table_name WHEN 'lineitem' THEN 0 ELSE 1 END AS INT) AS position
        FROM ({_counts(("lineitem", "orders"))})""",
    "materialize_summary": " UNION ALL ".join(map(_fingerprint, TABLES)),
    "materialize_resumed": _counts(more=", 'OK' AS status, CAST(1 AS BIGINT) AS copies"),
    "materialize_with_failure": _counts(("orders", "lineitem"), ", 'OK' AS status")
    + " UNION ALL SELECT 'supplier', -1, 'FAIL'",
    "strict_csv_copy": "SELECT * FROM documents",
    "materialize_totals": f"""
        SELECT count(*) AS ok, count(*) AS total, CAST(sum("rows") AS BIGINT) AS total_rows
        FROM ({_counts()})""",
    "multi_format": " UNION ALL ".join(
        f"""SELECT '{f}' AS format, count(*) AS "rows", 'OK' AS status FROM customer"""
        for f in ("parquet", "orc", "json", "csv")
    )
    + " UNION ALL SELECT 'nope', 0, 'SKIP'",
    "table_location": """
        SELECT 'orders' AS table_name, true AS found, count(*) AS "rows" FROM orders
        UNION ALL SELECT 'absent', false, 0""",
    "relax_nullability": "SELECT * FROM lineitem",
    "relax_nested": "SELECT o_orderkey, o_orderstatus, o_orderkey AS again, true AS free FROM orders",
    "latest_by_key": _LATEST_EVENT.format(order="value DESC, event_id DESC"),
    "keyed_write": """
        SELECT * FROM orders QUALIFY row_number()
        OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
    "stream_insert": "SELECT event_id, ts, user_id, event_type, value, props FROM events",
    "keyed_upsert": _LATEST_EVENT.format(order="ts DESC, event_id DESC"),
    "keyed_snapshot": _LATEST_EVENT.format(order="ts DESC, event_id DESC"),
}
