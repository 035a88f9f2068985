"""Where results go: Parquet tables, or one file for each saved item."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..operators.retry import RetryConfig, retry
from ..operators.saving import last_writers


def save_table(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def save_files(items: DataFrame, output_dir: str, order: str = "rank", config: RetryConfig | None = None) -> DataFrame:
    """Write content (binary or text) of items (host, save_path, content, order) under output_dir; save_path, path and skipped_on of each.

    output_dir is a URI or path of a store that all executors reach. Of items with the same path the last one is written,
    items without content are not. Writing again overwrites; a write that keeps failing is skipped at 'save'.
    """
    last = last_writers(items.filter("content is not null"), order).selectExpr("save_path", "cast(content as binary) as content")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(output_dir) if "://" in output_dir else (fs.LocalFileSystem(), output_dir)

        def put(path: str, content: bytes) -> None:
            store.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(path) as out:
                out.write(content)

        for batch in batches:
            rows = []
            for save_path, content in zip(*(c.to_pylist() for c in batch.columns)):
                path = f"{base.rstrip('/')}/{save_path.lstrip('/')}"
                try:
                    retry(lambda: put(path, content), config)
                    rows.append((save_path, path, None))
                except Exception:
                    rows.append((save_path, path, "save"))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["save_path", "path", "skipped_on"])

    return last.mapInArrow(write, "save_path string, path string, skipped_on string")
