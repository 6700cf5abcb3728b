"""The label space: rows of faces, their ids made unique, admitted or rejected with a reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.keys import charset, missing


def unique_ids(faces: DataFrame) -> DataFrame:
    """faces (face_id, path) with #2, #3 ... after the ids of later paths, counted before anything is rejected."""
    n = F.row_number().over(Window.partitionBy("face_id").orderBy("path"))
    return faces.withColumn("n", n).withColumn("face_id", F.when(F.col("n") == 1, F.col("face_id")).otherwise(F.concat("face_id", F.lit("#"), F.col("n").cast("string")))).drop("n")


def admitted(faces: DataFrame, spec: str = "ascii_alnum", include_variable: bool = False) -> DataFrame:
    """faces (face_id, path, variable, codepoints) with status, reason, detail; a variable face before missing glyphs."""
    lack = missing(F.lit(charset(spec)), F.col("codepoints"))
    variable = F.col("variable") & F.lit(not include_variable)
    reason = F.when(variable, "variable-font").when(lack != "", "missing-glyphs")
    return unique_ids(faces).withColumn("reason", reason).withColumns({"status": F.when(F.col("reason").isNull(), "kept").otherwise("rejected"), "detail": F.when(F.col("reason") == "missing-glyphs", F.substring(lack, 1, 24))})
