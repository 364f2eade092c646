"""Numbers of lines and tables zipped by position."""

import pytest

from colloquy.sources.line_files import numbered_lines, zip_lines


@pytest.mark.parametrize("limit", [40, 1 << 20])
def test_numbers(spark, tmp_path, limit):
    """Over several files and ranges; empty lines count, a last line may be open."""
    lines = [f"line {n}" * (n % 4) for n in range(90)]
    (tmp_path / "part-0").write_text("\n".join(lines[:50]) + "\n")
    (tmp_path / "part-1").write_text("")
    (tmp_path / "part-2").write_text("\n".join(lines[50:]))
    keys = {"spark.sql.files.maxPartitionBytes": str(limit),
            "spark.sql.files.openCostInBytes": "1"}
    for key, value in keys.items():
        spark.conf.set(key, value)
    try:
        got = numbered_lines(spark, str(tmp_path)).collect()
    finally:
        for key in keys:
            spark.conf.unset(key)
    assert [r.value for r in sorted(got)] == lines
    assert sorted(r.line for r in got) == list(range(90))


def test_zip(spark, tmp_path):
    (tmp_path / "a").write_text("1\n2\n\n")
    (tmp_path / "b").write_text("x\ny\nz")
    (tmp_path / "c").write_text("x\ny\n")
    files = {n: str(tmp_path / n) for n in "abc"}
    got = sorted(zip_lines(spark, {"left": files["a"], "right": files["b"]}).collect())
    assert [tuple(r) for r in got] == [(0, "1", "x"), (1, "2", "y"), (2, "", "z")]
    for pair in (("b", "c"), ("c", "b")):
        with pytest.raises(Exception, match="unequal length"):
            zip_lines(spark, {n: files[n] for n in pair}).collect()
