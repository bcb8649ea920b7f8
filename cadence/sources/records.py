"""Ragged records: CSV or JSON files of any header to canonical text columns."""

from __future__ import annotations

import csv
import io
import json
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.functions.scalars import normalize_key

# Names under which each canonical column is found, the first that is there wins; objects that are unfolded.
ALIASES = {
    "id": ("id", "video_id", "content_id", "video", "title", "nombre"),
    "platform": ("platform", "plataforma", "source_platform", "network"),
    "date": ("date", "fecha", "published_at", "publish_date"),
    "period": ("period", "periodo", "date_range", "window"),
    "organic_or_ads": ("organic_or_ads", "organic_ads", "traffic_type", "source_type"),
    "country": ("country", "pais", "country_code"),
    "language": ("language", "idioma", "lang"),
    "audience": ("audience", "segment", "audience_segment"),
    "topic": ("topic", "tema", "content_topic", "category"),
    "hook_type": ("hook_type", "hook", "tipo_hook", "opening_type"),
    "edit_style": ("edit_style", "editing_style", "estilo_edicion", "format"),
    "audio_type": ("audio_type", "music_type", "audio_role", "sound_type"),
    "captioned": ("captioned", "captions", "subtitles", "subtitulado"),
    "cta": ("cta", "call_to_action", "action"),
    "experiment_id": ("experiment_id", "experiment", "test_id", "variant_group"),
    "variable_changed": ("variable_changed", "changed_variable", "test_variable"),
    "duration_s": ("duration_s", "duration", "duration_seconds", "video_length", "duracion"),
    "views": ("views", "view", "plays", "play_count", "video_views", "reproducciones"),
    "reach": ("reach", "accounts_reached", "unique_reach", "alcance"),
    "impressions": ("impressions", "impression", "impresiones"),
    "watch_time_s": ("watch_time_s", "watch_time", "total_watch_time", "watch_time_seconds"),
    "average_watch_time_s": ("average_watch_time_s", "average_watch_time", "avg_watch_time", "average_view_duration", "avg_view_duration", "tiempo_medio"),
    "average_percentage_viewed": ("average_percentage_viewed", "avg_percentage_viewed", "average_viewed", "apv", "porcentaje_medio_visto"),
    "completion_rate": ("completion_rate", "completion", "completion_percentage", "full_watch_rate", "finalizacion"),
    "engaged_views": ("engaged_views", "engaged_view", "vistas_con_interaccion"),
    "stayed_to_watch_rate": ("stayed_to_watch_rate", "stayed_to_watch", "chose_to_view", "viewed_rate", "stayed_rate"),
    "retention_2s": ("retention_2s", "retention_2_sec", "2s", "2_sec", "view_2s"),
    "retention_3s": ("retention_3s", "retention_3_sec", "3s", "3_sec", "view_3s"),
    "retention_6s": ("retention_6s", "retention_6_sec", "6s", "6_sec", "view_6s"),
    "retention_25": ("retention_25", "retention_25pct", "25_percent", "25"),
    "retention_50": ("retention_50", "retention_50pct", "50_percent", "50"),
    "retention_75": ("retention_75", "retention_75pct", "75_percent", "75"),
    "retention_100": ("retention_100", "retention_100pct", "100_percent", "100"),
    "likes": ("likes", "like_count", "me_gusta", "me_gusta_count"),
    "comments": ("comments", "comment_count", "comentarios"),
    "shares": ("shares", "share_count", "compartidos"),
    "saves": ("saves", "save_count", "guardados"),
    "follows": ("follows", "followers_gained", "new_followers", "seguidores_ganados"),
    "clicks": ("clicks", "link_clicks", "outbound_clicks", "clics"),
    "conversions": ("conversions", "conversion_count", "purchases", "leads", "conversiones"),
    "revenue": ("revenue", "sales", "income", "ingresos"),
    "spend": ("spend", "cost", "ad_spend", "gasto"),
}
FOLDED = ["metrics", "data", "analytics", "metadata", "creative", "attributes", "retention", "retention_curve"]
LISTS = ["videos", "items", "data", "records"]


def pick(column: str, names: list[str]) -> Column:
    """The value of the first name that a text map has, even if that value is null."""
    out = F.lit(None).cast("string")
    for name in reversed(names):
        out = F.when(F.map_contains_key(F.col(column), F.lit(name)), F.try_element_at(F.col(column), F.lit(name))).otherwise(out)
    return out


def flatten(records: DataFrame, column: str = "record") -> DataFrame:
    """A JSON object per row (text) -> column ``flat``: keys normalised, known inner objects unfolded, the last writer of a key wins."""
    entries = F.map_entries(F.from_json(column, "map<string,string>"))
    keyed = F.transform(entries, lambda e: F.struct(normalize_key(e["key"]).alias("key"), e["value"].alias("value")))
    inner = lambda e: F.transform(F.map_entries(F.from_json(e["value"], "map<string,string>")), lambda c: F.struct(normalize_key(c["key"]).alias("key"), c["value"].alias("value")))
    unfolded = F.flatten(F.transform(keyed, lambda e: F.when(e["key"].isin(FOLDED) & F.trim(e["value"]).startswith("{"), inner(e)).otherwise(F.array(e))))
    # of equal keys the last stays
    last = F.filter(unfolded, lambda e, i: ~F.exists(F.slice(unfolded, i + 2, F.greatest(F.size(unfolded) - i - 1, F.lit(0))), lambda l: l["key"] == e["key"]))
    return records.withColumn("flat", F.map_from_entries(last))


def canonical(flat: DataFrame, column: str = "flat") -> DataFrame:
    """All canonical columns as text from a flat map, by their aliases."""
    return flat.select(*[c for c in flat.columns if c != column], *[pick(column, list(dict.fromkeys([name, *names]))).alias(name) for name, names in ALIASES.items()])


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON file (a list, or an object that holds a list): row_number and record (text)."""
    return from_text(spark.read.text(path, wholetext=True))


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Records of files with an object a line, read in splits: row_number (ascending, with gaps) and record."""
    return spark.read.text(path).filter(F.trim("value").startswith("{")).select((F.monotonically_increasing_id() + 1).alias("row_number"), F.col("value").alias("record"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Canonical text columns of a file of records, whatever it is called: what begins with a bracket or brace is JSON, all else CSV. ``-`` is
    standard input."""
    if path == "-":
        return canonical(flatten(of_input(spark, sys.stdin.read())))
    first = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
    if path.lower().endswith(".csv") or not first or not first[0]["value"].lstrip().startswith(("{", "[")):
        return read_csv(spark, path)
    return canonical(flatten(read_json(spark, path)))


def of_input(spark: SparkSession, text: str) -> DataFrame:
    """Records of a text at hand."""
    if text.lstrip().startswith(("{", "[")):
        return from_text(spark.createDataFrame([(text,)], "value string"))
    rows = [(k, json.dumps(row, ensure_ascii=False)) for k, row in enumerate(csv.DictReader(io.StringIO(text)), 1)]
    return spark.createDataFrame(rows, "row_number long, record string")


def from_text(texts: DataFrame) -> DataFrame:
    """Records of whole JSON texts (column value); a text that holds no list of records fails."""
    whole = texts.select(F.trim("value").alias("value"))
    arrays = [F.get_json_object("value", f"$.{name}") for name in LISTS]
    body = F.when(F.col("value").startswith("["), F.col("value")).otherwise(F.coalesce(*[F.when(F.trim(a).startswith("["), a) for a in arrays]))
    items = F.from_json(body, "array<string>")
    return whole.select(F.posexplode(items).alias("i", "record")).filter(F.trim("record").startswith("{")).select((F.col("i") + 1).cast("long").alias("row_number"), "record")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Records of a CSV file with any header, as text columns under canonical names; unknown columns are dropped."""
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=True)
    names = spark.createDataFrame([(i, c) for i, c in enumerate(raw.columns)], "i int, c string").select("i", normalize_key(F.col("c")).alias("k")).collect()
    have = {r["k"]: raw.columns[r["i"]] for r in names}  # one row a column of the header
    chosen = []
    for name, aliases in ALIASES.items():
        found = next((have[a] for a in dict.fromkeys([name, *aliases]) if a in have), None)
        chosen.append((F.col(f"`{found}`") if found else F.lit(None).cast("string")).alias(name))
    return raw.select(*chosen)
