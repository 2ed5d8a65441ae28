"""A stream gives what a batch gives, in one go or in two."""

from vellumix.operators import repair
from vellumix.streaming import files


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"https://x.org/{i}", f'<p>a  b<br>{i}</p><a href="/l{i}">&amp;quot;</a>') for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ("page_id < 12", "page_id >= 12"):
        df.filter(part).write.mode("append").parquet(src)
        files.write(files.repaired(files.read_documents(spark, src)), out, str(tmp_path / "cp")).awaitTermination(90)
    want = repair.repair_documents(df, "url", "html")
    assert sorted(spark.read.parquet(out).select("page_id", "html", "changed").collect()) == sorted(want.select("page_id", "html", "changed").collect())
    links = str(tmp_path / "links")
    files.write(files.links(files.read_documents(spark, src)), links, str(tmp_path / "cp2")).awaitTermination(90)
    assert {tuple(r) for r in spark.read.parquet(links).collect()} == {(i, f"/l{i}") for i in range(20)}
