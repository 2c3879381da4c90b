"""tableforge: build, check and stream tables with the DataFrame and SQL APIs.

Every function takes a session or DataFrames and returns DataFrames (or a
``StreamingQuery``); none starts a session of its own.
"""

from tableforge.functions.columns import (
    any_like,
    bounded_decimal,
    bounded_int,
    starts_with_any,
    to_money,
)
from tableforge.functions.nullability import read_relaxed, relax_nested, relax_nullability, relaxed_type
from tableforge.operators.contents import Contents, contents
from tableforge.operators.latest import latest_by_key, write_keyed
from tableforge.operators.tables import (
    add_new_partitions,
    create_checked,
    create_strict,
    ctas,
    drop_table,
    ensure_database,
    read_csv,
    register_external,
    save_checked,
    save_table,
    show_tables,
    table_location,
    vacuum,
    write_csv,
)
from tableforge.operators.words import distinct_words, tokens, top_words, word_count
from tableforge.plans.jobs import (
    MaterializeError,
    generated_stream_job,
    materialize_catalog,
    select_tables,
    table_job,
    totals,
    word_count_job,
    write_formats,
)
from tableforge.plans.journal import Journal
from tableforge.settings import recommended_conf
from tableforge.sources.catalogs import NamedCatalog, ScaleCatalog
from tableforge.sources.generated import (
    datagen_batch,
    datagen_columns,
    datagen_stream,
    demo_columns,
    demo_rows,
)
from tableforge.sources.sequences import SequenceSource, register_sequence
from tableforge.sources.lines import fetch_lines, lines_from_values, read_lines, spread
from tableforge.streaming.inserts import await_sequence_end, stream_insert
from tableforge.streaming.keyed import KeyedTable, stream_upsert

__all__ = [
    "Contents",
    "Journal",
    "KeyedTable",
    "MaterializeError",
    "NamedCatalog",
    "ScaleCatalog",
    "SequenceSource",
    "any_like",
    "await_sequence_end",
    "bounded_decimal",
    "bounded_int",
    "contents",
    "create_checked",
    "create_strict",
    "ctas",
    "datagen_batch",
    "datagen_columns",
    "datagen_stream",
    "demo_columns",
    "demo_rows",
    "distinct_words",
    "drop_table",
    "ensure_database",
    "fetch_lines",
    "generated_stream_job",
    "latest_by_key",
    "lines_from_values",
    "materialize_catalog",
    "read_csv",
    "read_lines",
    "read_relaxed",
    "recommended_conf",
    "add_new_partitions",
    "read_urls",
    "register_external",
    "register_sequence",
    "relax_nested",
    "relax_nullability",
    "relaxed_type",
    "save_checked",
    "save_table",
    "select_tables",
    "show_tables",
    "spread",
    "starts_with_any",
    "stream_insert",
    "stream_upsert",
    "table_job",
    "table_location",
    "to_money",
    "tokens",
    "top_words",
    "totals",
    "vacuum",
    "word_count",
    "word_count_job",
    "write_csv",
    "write_formats",
    "write_keyed",
]
