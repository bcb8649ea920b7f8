"""WAV files and catalogues as data sources."""

import io
import wave

import numpy as np
import pytest

from cadence.sources import recordings as R


def _file(path, x, rate=48_000, width=2, channels=1):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(R.encode(x, width))


@pytest.fixture(scope="module")
def source(spark):
    R.register(spark)
    return lambda path, **options: spark.read.format("wav").options(path=str(path), **options).load()


def test_files_are_read_in_ranges(source, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    x, y = rng.uniform(-1, 1, 10_000), rng.uniform(-1, 1, 700)
    _file(tmp_path / "a.wav", x)
    _file(tmp_path / "b.WAV", y, 16_000, 3)
    (tmp_path / "notes.txt").write_text("no recording")
    monkeypatch.setattr(R, "RANGE", 4000)
    df = source(tmp_path, block=500)
    reader = R.WavReader(str(tmp_path), 500)
    assert len(reader.partitions()) == 5 + 1  # four blocks of two bytes a sample a range, two blocks of three bytes
    rows = sorted(df.collect(), key=lambda r: (r.path, r.block))
    a = [r for r in rows if r.path.endswith("a.wav")]
    b = [r for r in rows if r.path.endswith("b.WAV")]
    assert [r.block for r in a] == list(range(20)) and [len(r.samples) for r in b] == [500, 200]
    assert np.abs(np.concatenate([r.samples for r in a]) - x).max() <= 0.5001 / 2**15
    assert np.abs(np.concatenate([r.samples for r in b]) - y).max() <= 0.5001 / 2**23
    assert (a[0].rate, a[0].label, a[0].frames, b[0].rate, b[0].label) == (48_000, "PCM_16", 10_000, 16_000, "PCM_24")
    assert abs(b[0].seconds - 700 / 16_000) < 1e-12


def test_filters_leave_ranges_out(source, tmp_path, monkeypatch):
    for name in "abc":
        _file(tmp_path / f"{name}.wav", np.zeros(10_000))
    monkeypatch.setattr(R, "RANGE", 1000)
    reader = R.WavReader(str(tmp_path), 500)
    left = list(reader.pushFilters([R.EqualTo(("path",), f"{tmp_path}/b.wav"), R.GreaterThan(("block",), 3), R.LessThanOrEqual(("block",), 7), R.EqualTo(("rate",), 48_000)]))
    assert left == [R.EqualTo(("rate",), 48_000)]
    assert [(p.path[-5:], p.first, p.last) for p in reader.partitions()] == [("b.wav", k, k + 1) for k in (4, 5, 6, 7)]
    df = source(tmp_path, block=500).filter(f"path = '{tmp_path}/b.wav' and block > 3 and block <= 7")
    assert sorted(r.block for r in df.collect()) == [4, 5, 6, 7]
    assert "block" in df._jdf.queryExecution().executedPlan().toString()
    assert source(tmp_path, block=500).filter("block > 99").count() == 0


def test_two_channels_are_averaged_and_others_refused(source, tmp_path):
    _file(tmp_path / "two.wav", np.array([0.5, 0.25, -0.5, 0.5]), channels=2)
    assert np.allclose(source(tmp_path / "two.wav").first().samples, [0.375, 0.0], atol=1e-4)
    for name, options, why in (("rate", {"rate": 8000}, "rate 8000"), ("three", {"channels": 3}, "3 channels"), ("none", {}, "no samples")):
        _file(tmp_path / f"{name}.wav", np.zeros(0 if name == "none" else 9), **options)
        with pytest.raises(Exception, match=why):
            source(tmp_path / f"{name}.wav").count()
    (tmp_path / "empty.wav").write_bytes(b"")
    (tmp_path / "text.wav").write_bytes(b"not a recording at all")
    for name, why in (("empty", "empty"), ("text", "not a WAV"), ("absent", "absent")):
        with pytest.raises(Exception, match=why):
            source(tmp_path / f"{name}.wav").count()


def test_extended_headers_and_odd_chunks():
    body = R.encode(np.array([0.5, -0.5, 0.25]), 3)
    form = b"fmt " + (40).to_bytes(4, "little") + (0xFFFE).to_bytes(2, "little") + (1).to_bytes(2, "little") + (44_101).to_bytes(4, "little") + bytes(6) + (24).to_bytes(2, "little") + (22).to_bytes(2, "little") + bytes(6) + (1).to_bytes(2, "little") + bytes(14)
    data = b"RIFF" + bytes(4) + b"WAVE" + b"LIST" + (3).to_bytes(4, "little") + b"abc\0" + form + b"data" + (0xFFFFFFFF).to_bytes(4, "little") + body
    h = R.header(lambda at, n: data[at : at + n], len(data))
    assert (h.rate, h.width, h.frames) == (44_100, 3, 3)
    assert np.allclose(R.decode(data[h.start :], h), [0.5, -0.5, 0.25])


def test_written_files_are_read_back(spark, source, tmp_path):
    rng = np.random.default_rng(5)
    clips = {f"clip{k}": rng.uniform(-1.2, 1.2, 1700 + k) for k in range(4)}
    rows = [(name, k, x[a : a + 500].tolist()) for name, x in clips.items() for k, a in enumerate(range(0, len(x), 500))]
    df = spark.createDataFrame(rows, "path string, block long, samples array<double>").repartition(3)
    out = tmp_path / "out"
    df.repartition(4, "path").sortWithinPartitions("path", "block").write.format("wav").options(path=str(out), rate=44_100).mode("append").save()
    got = {}
    for r in sorted(source(out, block=600).collect(), key=lambda r: (r.path, r.block)):
        got.setdefault(r.path.rsplit("/", 1)[1][:-4], []).extend(r.samples)
        assert (r.rate, r.label) == (44_100, "PCM_24")
    assert got.keys() == clips.keys()
    for name, x in clips.items():
        assert np.abs(np.array(got[name]) - np.clip(x, -1, 1 - 2**-23)).max() <= 0.5001 / 2**23
        with wave.open(str(out / f"{name}.wav")) as w:
            assert (w.getsampwidth(), w.getnframes(), w.getframerate()) == (3, len(x), 44_100)


def test_failed_jobs_leave_no_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, [0.0]), ("a", 2, [0.0])], "path string, block long, samples array<double>").coalesce(1)
    with pytest.raises(Exception, match="none missing"):
        df.write.format("wav").options(path=str(tmp_path)).mode("append").save()
    assert not list(tmp_path.glob("*.wav"))


def test_catalogue_pushes_its_filters(spark, source, tmp_path):
    path = str(tmp_path / "items")
    spark.range(1000).selectExpr("id", "concat('item ', id) name", "cast(id % 7 as int) kind").coalesce(1).write.option("parquet.block.size", "2048").parquet(path)
    df = spark.read.format("catalogue").option("path", path).load()
    assert df.count() == 1000
    hit = df.filter("id >= 900 and kind = 3 and name like '%1'")
    assert sorted(r.id for r in hit.collect()) == [k for k in range(900, 1000) if k % 7 == 3 and k % 10 == 1]
    reader = R.CatalogueReader(path)
    assert not list(reader.pushFilters([R.GreaterThanOrEqual(("id",), 5000)]))
    assert reader.partitions() == [R.InputPartition(None)] or len(reader.partitions()) == 0 or reader.partitions()[0].value is None
