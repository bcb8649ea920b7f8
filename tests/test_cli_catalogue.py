"""Commands over files, and catalogue searches."""

import json

import pytest
from pyspark.sql import functions as F

from cadence import cli
from cadence.sources import catalogue


def test_metrics_command(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda *_: spark)
    rows = [{"id": f"v{i}", "platform": ["TikTok", "Reels"][i % 2], "views": 100 + i, "likes": i, "shares": 3, "saves": 1, "duration": "0:20", "average_watch_time": 10 - i, "retention_2s": "70%", "retention_6s": "40%"} for i in range(6)]
    (tmp_path / "m.json").write_text(json.dumps({"videos": rows}))
    assert cli.main(["metrics", "--input", str(tmp_path / "m.json"), "--output", str(tmp_path / "r.json")]) == 0
    report = json.loads((tmp_path / "r.json").read_text())
    assert [r["id"] for r in report["ranking"] if r["side"] == "top"][0] == "v0" and {r["insight"] for r in report["insights"]} >= {"ranking", "platform", "early_loss", "opening"}
    assert {r["label"]: r["n"] for r in report["groups"] if r["dimension"] == "platform"} == {"tiktok": 3, "instagram_reels": 3}
    (tmp_path / "m.csv").write_text("id,views\n")
    assert cli.main(["metrics", "--input", str(tmp_path / "m.csv")]) == 2
    assert cli.main(["metrics", "--input", str(tmp_path / "none.json")]) == 2


def test_spec_command(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda *_: spark)
    (tmp_path / "b.json").write_text('{"platform": "Shorts", "duration_s": 12}')
    assert cli.main(["spec", "--input", str(tmp_path / "b.json"), "--format", "markdown", "--output", str(tmp_path / "s.md")]) == 0
    assert "youtube_shorts" in (tmp_path / "s.md").read_text()
    (tmp_path / "bad.json").write_text("[1]")
    assert cli.main(["spec", "--input", str(tmp_path / "bad.json")]) == 2


def test_catalogue(spark):
    df = spark.createDataFrame([(i, "photo" if i % 2 else "film", f"Red Bird {i}", i * 10) for i in range(20)], "id long, type string, tags string, views long")
    got = catalogue.search(df, ["id"], page=2, per_page=1, text="bird red", equal={"type": "photo", "tags": None}, ranges={"views": (50, None)})
    assert [r["id"] for r in got.collect()] == [11, 13, 15]  # a page has three at least
    assert catalogue.get(df, 4).first()["views"] == 40
    with pytest.raises(Exception, match="no id 99"):
        catalogue.get(df, 99).collect()
    hit = spark.range(1).select(F.from_json(F.lit('{"sizes": {"large": {"url": "", "size": 0}, "small": {"url": "u", "size": 0}}}'), catalogue.HIT).alias("h")).select("h.*")
    kept = catalogue.trimmed(hit).select("sizes", catalogue.choose(F.col("sizes"), ["large", "small"]).alias("c")).first()
    assert list(kept["sizes"]) == ["small"] and kept["c"]["url"] == "u"
    cache = spark.sql("select 'a' as url, 'old' as payload, timestamp'2024-01-01 00:00:00' as cached_at union all select 'a', 'new', timestamp'2024-01-02 00:00:00' union all select 'b', 'gone', timestamp'2023-12-01 00:00:00'")
    assert [r["payload"] for r in catalogue.fresh(cache, F.lit("2024-01-02 00:00:00").cast("timestamp")).collect()] == ["new"]
