import pytest

SCHEMAS = {
    "docs": "doc_id long, batch_id int, url string, final_url string, doc_type string, sha256 string, etag string, title string, extraction string, extract_warning string, warning string, signals array<string>, links array<string>, fetched_at timestamp, updated_at timestamp",
    "chunks": "doc_id long, seq int, chunk_id long, text string, start_char int, start_byte long",
    "vectors": "chunk_id long, model string, dim int, vec array<float>",
    "serp_results": "result_id long, query_id long, query_text string, provider string, rank int, title string, url string, snippet string, fetched_at timestamp",
    "documents": "doc_id long, text string, lang string, source string, n_chars long, site string, added_at timestamp",
    "eval_items": "item_id long, suite string, text string, answer string",
    "mix_targets": "source string, target_share double, max_repeats int",
    "split_limits": "doc_type string, max_chars int, overlap_chars int",
}
# Names that the operators use inside; tables may bring columns of the same names.
CLASHES = ["key", "n", "cls", "h", "pos", "host", "shard", "shards", "size", "df", "rep", "value", "field", "id", "kind", "tokens", "blocks", "lane", "found", "item", "parts", "code", "keys", "held", "whole", "label", "pages", "own", "refs", "batch", "sha", "page", "minima", "bytes", "rank_", "neighbour", "similarity", "start", "end", "idx", "line_no", "accepted", "item_ids"]


@pytest.fixture(scope="session")
def make(spark, tmp_path_factory):
    """make(rows by table, clash=False) writes all tables and returns their folder; rows are dicts."""

    def run(tables: dict[str, list[dict]], clash: bool = False) -> str:
        from pyspark.sql import functions as F
        from pyspark.sql.types import _parse_datatype_string

        folder = tmp_path_factory.mktemp("tables")
        for name, ddl in SCHEMAS.items():
            schema = _parse_datatype_string(ddl)
            rows = [tuple(r.get(f.name) for f in schema) for r in tables.get(name, [])]
            df = spark.createDataFrame(rows, schema)
            if clash:
                df = df.select("*", *(F.lit(f"{i}").alias(c) for i, c in enumerate(CLASHES) if c not in df.columns))
            df.write.parquet(str(folder / f"{name}.parquet"))
        return str(folder)

    return run
