"""Waves that hold a whole large stream."""

from murmuration.operators import timing


def test_intensity_beyond_32_bits(spark, monkeypatch):
    wave = spark.createDataFrame([(0, 10_000_000, 6_000_000, 90_000, ["x"])], "start_us bigint, end_us bigint, events int, authors int, actors array<string>")
    monkeypatch.setattr(timing, "greedy_windows", lambda *a: wave)
    assert timing.attack_waves(None).first()["intensity"] == 6_000_000 * 90_000 / 10
