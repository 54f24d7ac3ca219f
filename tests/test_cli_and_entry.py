"""The command line, the stream extension and the registered queries."""

from __future__ import annotations

import io

import __spark_entry__
from sieveline import Query, cli
from sieveline.operators import postings as px, search as se
from sieveline.sources import corpus as source
from sieveline.streaming import incremental


def test_cli(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.rs").write_text("fn main() {}\nfn hello() {}\n")
    (src / "b.md").write_text("Hello there")
    (src / "c.rs").write_bytes(b"\0\0\0\0")
    out = io.StringIO()
    cli.run(spark, cli.parser().parse_args(["index", str(src), "-o", str(tmp_path / "idx"), "--exclude", "*.tmp"]), out)
    assert "Binary: 1 files, 4 bytes" in out.getvalue() and "None: 2 files" in out.getvalue()

    def search(*args):
        out = io.StringIO()
        cli.run(spark, cli.parser().parse_args(["search", str(tmp_path / "idx"), *args]), out)
        return out.getvalue().splitlines()

    assert search("hello") == ["a.rs:2:fn hello() {}"]
    assert search("hello", "-i") == ["a.rs:2:fn hello() {}", "b.md:0:Hello there"]
    assert search(r"fn \w+\(", "-r", "-f", "*.rs") == ["a.rs:1:fn main() {}", "a.rs:2:fn hello() {}"]
    assert search("hello", "-c", "1") == ["a.rs-1-fn main() {}", "a.rs:2:fn hello() {}"]
    assert cli.main(["search", str(tmp_path / "none"), "x"]) == 1


def test_stream(spark, tmp_path):
    docs = source.from_rows(spark, [("a", "abc abc"), ("b", "xabcx")]).select("file_idx", "path", "text")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    q = incremental.matches_stream(stream, Query("abc")).writeStream.format("memory").queryName("hits").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(spark.table("hits").collect()) == sorted(se.search_literal(docs, "abc").collect())
    incremental.index_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck"), availableNow=True).awaitTermination(120)
    index = incremental.opened(spark, str(tmp_path / "out"))
    assert index.file_count() == 2 and sorted(px.search(index, Query("abc")).collect()) == sorted(se.search_literal(docs, "abc").collect())


def test_entry(spark):
    names = set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= names and len(names) > 50
    assert {"literal_matches", "regex_matches", "search_stats"} <= names
