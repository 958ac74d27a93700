"""Sinks: tables with a summary beside them, surfaces, and a page of danger zones. All writes go through Spark."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pitchframe.operators.threat import Surface


def text_file(spark: SparkSession, text: str, path: str) -> None:
    """A small text as a folder with one part."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path, lineSep="\n")


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"]


def table_with_summary(df: DataFrame, path: str, summary: DataFrame, partition_by: list[str] | None = None) -> dict:
    """Parquet below path/table and one row of figures as JSON below path/summary, which is also returned."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/table")
    row = summary.select(F.to_json(F.struct(*summary.columns)).alias("j")).first()
    text_file(df.sparkSession, row["j"] if row else "{}", f"{path}/summary")
    return json.loads(row["j"]) if row else {}


def observed(df: DataFrame, path: str, figures: dict[str, Column], kind: str = "parquet", partition_by: list[str] | None = None) -> dict:
    """df written to path, and its rows and figures (aggregates) as they were seen on the way: one job, nothing is read again."""
    seen = Observation()
    own = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(name) for name, c in figures.items()])
    writer = own.write.mode("overwrite").format(kind).options(**({"header": "true"} if kind == "csv" else {}))
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
    return dict(seen.get)


def tables(parts: dict[str, DataFrame], path: str, kind: str = "parquet", figures: dict[str, dict[str, Column]] = {}, about: dict | None = None) -> dict[str, int]:
    """Several tables below one path, with a manifest: what is told about them, and the rows and figures of each."""
    found = {name: observed(df, f"{path}/{name}", figures.get(name, {}), kind) for name, df in parts.items()}
    first = next(iter(parts.values()))
    text_file(first.sparkSession, json.dumps({**(about or {}), "tables": found}, default=str), f"{path}/manifest")
    return {name: own["rows"] for name, own in found.items()}


def load_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(read_text(spark, f"{path}/manifest"))


def save_surface(spark: SparkSession, surface: Surface, path: str) -> None:
    text_file(spark, surface.to_json(), path)


def load_surface(spark: SparkSession, path: str, top_first: bool = False) -> Surface:
    return Surface.from_json(read_text(spark, path).strip(), top_first)


def danger_zone_page(payload: str, title: str) -> str:
    """A page that holds the payload and shows a team's cells; `</` in the payload can't end its script."""
    safe = payload.replace("</", "<\\/")
    return (
        f"<!doctype html><html><head><meta charset='utf-8'><title>{title}</title></head><body><h1>{title}</h1><select id='team'></select>"
        f"<svg id='pitch' viewBox='-52.5 -34 105 68' width='840'></svg><script id='data' type='application/json'>{safe}</script><script>"
        "const data=JSON.parse(document.getElementById('data').textContent),box=document.getElementById('team'),svg=document.getElementById('pitch');"
        "for(const t of data){const o=document.createElement('option');o.text=t.team;box.add(o)}"
        "function show(){const t=data[box.selectedIndex],m=Math.max(...t.cells.map(c=>c.xT),1e-9);svg.innerHTML=t.cells.map(c=>"
        "`<rect x='${c.x0}' y='${-c.y1}' width='${c.x1-c.x0}' height='${c.y1-c.y0}' fill='rgba(180,30,60,${c.xT/m})'><title>${c.actions}: ${c.xT}</title></rect>`).join('')}"
        "box.onchange=show;if(data.length)show();</script></body></html>"
    )
