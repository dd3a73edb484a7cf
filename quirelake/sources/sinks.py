"""Writers. Spark's commit protocol makes each table appear whole or not at all."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import normalized_box
from ..operators.postprocess import regions_json
from ..schema import REGION_TYPES


def write_jsonl(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).json(path)


def write_region_csv(rows: DataFrame, path: str, mode: str = "errorifexists", half_even: bool = True) -> None:
    """image and regions as JSON text."""
    rows.select(
        "image", regions_json(F.col("regions"), half_even).alias("regions")
    ).write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_solution_csv(pages: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The validation solution of pages: image, source and all regions as they are, as JSON text."""
    from ..operators.curation import valid_solution

    valid_solution(pages).select(
        "image", "source", F.to_json("regions").alias("regions")
    ).write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def report(sections: dict, most: int = 1000) -> dict:
    """A nested report as plain values: tables become lists of rows (one-row ones a row), up to ``most``; dicts are gone through; all else stays.

    Tables are rollups or top lists. Where one has more rows, ``truncated`` says so beside them.
    """

    def of(x):
        if isinstance(x, DataFrame):
            rows = [r.asDict(recursive=True) for r in x.limit(most + 1).collect()]
            return {"rows": rows[:most], "truncated": True} if len(rows) > most else rows[0] if len(rows) == 1 else rows
        return {k: of(v) for k, v in x.items()} if isinstance(x, dict) else x

    return of(sections)


def write_report(spark: SparkSession, sections: dict, path: str, title: str = "Report", mode: str = "errorifexists") -> None:
    """The nested report as one JSON text under ``path``/json, and its tables as Markdown under ``path``/markdown."""
    text = json.dumps(report(sections), ensure_ascii=False, indent=2, default=str)
    tables = [(k, v) for k, v in sections.items() if isinstance(v, DataFrame)]
    for name, content in (("json", text), ("markdown", markdown(title, tables))):
        spark.createDataFrame([(content,)], "value string").coalesce(1).write.mode(mode).option("lineSep", "\n").text(f"{path}/{name}")


def write_manifest(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    flat = rows.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in rows.dtypes])
    flat.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def detector_labels(pages: DataFrame, least: float = 5) -> DataFrame:
    """image and the lines of its label file: class number, centre and size with six places. Boxes under five pixels are left out."""
    number = F.create_map(*[F.lit(x) for i, t in enumerate(REGION_TYPES) for x in (t, i)])
    rows = pages.select(
        "image", F.posexplode("regions").alias("i", "r"), F.col("image_width").cast("double").alias("w"),
        F.col("image_height").cast("double").alias("h")
    )
    boxed = rows.select(
        "image", "i", number[F.coalesce("r.type", F.lit("handwritten"))].alias("class"),
        normalized_box(F.col("r.bbox"), F.col("w"), F.col("h")).alias("b")
    ).where("b IS NOT NULL AND class IS NOT NULL")
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "class", F.col("b")[0], F.col("b")[1], F.col("b")[2], F.col("b")[3])
    return boxed.groupBy("image").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("line")))), lambda x: x["line"]), "\n").alias("label")
    )


def write_detector_labels(pages: DataFrame, path: str, mode: str = "errorifexists") -> None:
    detector_labels(pages).write.mode(mode).partitionBy("image").text(path)


def viewer_json(annotated: DataFrame) -> DataFrame:
    """image and one JSON text of its annotated regions."""
    fields = [c for c in annotated.columns if c != "image"]
    return annotated.groupBy("image").agg(F.to_json(F.array_sort(F.collect_list(F.struct(*fields)))).alias("json"))


def markdown(title: str, tables: Iterable[tuple[str, DataFrame]], most: int = 1000) -> str:
    """A report of small tables. Each is a rollup or a top list; ``most`` rows of one are shown and the text says if there are more."""
    lines = [f"# {title}", ""]
    for name, table in tables:
        rows = table.limit(most + 1).collect()
        lines += [f"## {name}", "", "| " + " | ".join(table.columns) + " |", "|" + "---|" * len(table.columns)]
        lines += ["| " + " | ".join("n/a" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows[:most]]
        lines += ["", f"More than {most} rows.", ""] if len(rows) > most else [""]
    return "\n".join(lines)
