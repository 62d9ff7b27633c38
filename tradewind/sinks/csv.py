"""Results as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_AS_TEXT = (T.DecimalType, T.TimestampType, T.TimestampNTZType)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Write ``df`` to the directory ``path``, replacing what is there.

    Header line, NULL and empty text as an empty field, decimals in plain digits at their scale.
    Text keeps every character: outer blanks, tabs and line breaks too. For that, records end in
    a line feed; Spark's writer would turn line feeds within values into any longer record end. An empty result still gets its header. ``single_file`` is for results
    that are already small, such as the reports; large ones keep one file per task.
    """
    texts = [
        F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, _AS_TEXT) else f.name
        for f in df.schema.fields
    ]
    out = df.select(*texts)
    (out.coalesce(1) if single_file else out).write.mode("overwrite").csv(
        path, header=True, quote='"', escape='"', emptyValue="", nullValue="", lineSep="\n",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
