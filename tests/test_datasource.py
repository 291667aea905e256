from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithoscope.sources import datasource, mseed, waveforms

T0 = datetime(2020, 2, 29, 23, 59, 58, 250000)


@pytest.fixture(scope="module")
def reader(spark):
    spark.dataSource.register(datasource.WaveformSource)
    return lambda path, **options: spark.read.format("waveform").options(**options).load(str(path))


def series(df):
    """Samples by source, records put together in order of time."""
    out = {}
    for r in df.orderBy("sid", "t0").collect():
        out.setdefault(r.sid, []).extend(r.data)
    return out


def test_one_large_file_is_many_tasks(spark, tmp_path, reader):
    rng, content, want = np.random.default_rng(1), b"", {}
    for k, length in enumerate((512, 4096, 256, 512, 1024)):  # lengths change within the file
        values = rng.integers(-10_000, 10_000, 3000)
        sid = f"IV.ST{k}..HHZ"
        content += mseed.to_bytes(sid, T0, 0.01, values, mseed.STEIM2 if k % 2 else mseed.STEIM1, length)
        want[sid] = values.tolist()
    (tmp_path / "all.mseed").write_bytes(content)
    for split in (128, 1000, 4096, 1 << 30):
        df = reader(tmp_path / "all.mseed", split=split)
        assert series(df) == want, split
        assert df.rdd.getNumPartitions() == max(1, -(-len(content) // (max(split // 128, 1) * 128)))
    assert sorted(map(tuple, reader(tmp_path, split=700).select("sid", "t0").collect())) == sorted((r["sid"], r["t0"]) for r in mseed.parse_records(content))


@pytest.mark.parametrize("kind", ["mseed", "sac", "dyna"])
def test_round_trips(spark, tmp_path, reader, kind):
    rows = [("IV.ABC.00.HHZ", T0, 0.005, [float(v) for v in range(-200, 300)]), ("IV.XYZ..HHN", T0 + timedelta(hours=1), 0.01, [1.0, -2.0, 4.0]), ("IV.XYZ..HHE", T0, 1.0, [7.0])]
    df = spark.createDataFrame(rows, "sid string, t0 timestamp_ntz, delta double, data array<double>").repartition(2)
    path = f"{tmp_path}/{kind}"
    full = df.selectExpr("*", "cast(null as int) as encoding")
    full.write.format("waveform").option("waveform", kind).mode("append").save(path)
    assert series(reader(path)) == {r[0]: r[3] for r in rows}
    starts = reader(path).groupBy("sid").agg(F.min("t0"), F.max("delta")).collect()
    assert {tuple(r) for r in starts} == {r[:3] for r in rows}
    with pytest.raises(Exception, match="FileExists"):
        full.write.format("waveform").option("waveform", kind).mode("append").save(path)
    full.where("sid = 'IV.XYZ..HHE'").write.format("waveform").option("waveform", kind).mode("overwrite").save(path)
    assert series(reader(path)) == {"IV.XYZ..HHE": [7.0]}


def test_formats_and_faults(spark, tmp_path, reader):
    (tmp_path / "a.sac").write_bytes(waveforms.build_sac("IV.A.00.HHZ", T0, 0.01, np.arange(5.0)))
    (tmp_path / "b.MSEED").write_bytes(mseed.to_bytes("IV.B.00.HHZ", T0, 0.01, np.arange(5)))
    (tmp_path / "c.txt").write_text("not a waveform")
    (tmp_path / "empty.mseed").write_bytes(b"")
    assert series(reader(tmp_path)) == {"IV.A.00.HHZ": [0.0, 1.0, 2.0, 3.0, 4.0], "IV.B.00.HHZ": [0.0, 1.0, 2.0, 3.0, 4.0]}
    assert list(series(reader(f"{tmp_path}/*.sac"))) == ["IV.A.00.HHZ"]
    (tmp_path / "odd").write_bytes((tmp_path / "b.MSEED").read_bytes())
    assert list(series(reader(tmp_path / "odd", waveform="mseed"))) == ["IV.B.00.HHZ"]
    for path, options in ((tmp_path / "c.txt", {"waveform": "mseed"}), (tmp_path / "none", {}), (tmp_path / "a.sac", {"waveform": "wav"})):
        with pytest.raises(Exception, match="no record found|none|no format"):
            reader(path, **options).collect()
