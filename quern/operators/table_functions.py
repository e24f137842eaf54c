"""Splitters as table functions, for LATERAL joins in SQL.

    run(spark, "SELECT d.id, c.* FROM docs d, LATERAL split_recursive(d.text, 512, 80) c", views, functions=TABLE_FUNCTIONS)

A row's text becomes its chunks in the task that has the row, in Arrow batches. A null or empty text has none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql.functions import udtf

from quern.operators import chunking, code_chunks

CHUNK = "chunk_index int, start_at int, end_at int, context string, table_header string, content string"


def _splitter(split: Callable) -> type:
    class Split:
        def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple]:
            plain = (text or "").replace("\r\n", "\n").replace("\r", "\n")
            for n, (a, b, crumb, head) in enumerate(split(plain, int(size), int(overlap)) if plain else []):
                yield n, a, b, crumb, head, plain[a:b]

    return Split


class SplitCode:
    def eval(self, text: str, size: int, extension: str) -> Iterator[tuple]:
        plain = (text or "").replace("\r\n", "\n").replace("\r", "\n")
        for n, (a, b, balanced, forced) in enumerate(code_chunks.split_code(plain, int(size), code_chunks.family(extension))):
            yield n, a, b, balanced, forced, plain[a:b]


#: Name in SQL and table function: (text, size, overlap) for texts, (text, size, extension) for code.
TABLE_FUNCTIONS = {f"split_{name}": udtf(_splitter(split), returnType=CHUNK, useArrow=True) for name, split in chunking.SPLITTERS.items()}
TABLE_FUNCTIONS["split_code"] = udtf(SplitCode, returnType="chunk_index int, start_at int, end_at int, balanced boolean, forced boolean, content string", useArrow=True)
