from monthlens.sources.tables import (  # noqa: F401
    TABLES, article_vectors, articles, macro_long, macro_wide, month, outcomes,
    read_csv_series, read_table, topics_long, write_partitioned,
)
