import os
import time

import pytest

from test_sources import PNG, docx
from textquarry import cli
from textquarry.engine import Engine
from textquarry.operators import search
from textquarry.streaming import ingest as streaming


@pytest.fixture
def root(tmp_path):
    (tmp_path / "corpus").mkdir()
    return tmp_path


def write(root, name, data):
    p = root / "corpus" / name
    p.write_bytes(data if isinstance(data, bytes) else data.encode())
    return p


def test_incremental(spark, root):
    note = write(root, "note.md", "# Frida\n\nRegisterNatives hook notes")
    write(root, "逆向 笔记.md", "# 逆向笔记\n\n这里记录风控设备指纹和参数分析。")
    write(root, "sample.docx", docx("<w:p><w:r><w:t>JNI_OnLoad RegisterNatives</w:t></w:r></w:p>", "sample"))
    write(root, "ignored.bin", b"x")
    write(root, "broken.docx", b"not a zip")
    e = Engine(spark, str(root))
    first = e.ingest()
    assert (first["seen"], first["indexed"], first["failed"], first["deleted"]) == (4, 3, 1, 0)
    assert {r.source_path for r in e.search("RegisterNatives").collect()} == {"corpus/note.md", "corpus/sample.docx"}
    hit, = e.search("设备指纹", top_k=3).collect()
    assert "风控设备指纹" in hit.text and hit.score == 0.0 and "设备指纹" in hit.snippet
    created = {r.source_path: r.created_at for r in e.store.read("documents").collect()}

    time.sleep(1.1)
    note.unlink()
    write(root, "逆向 笔记.md", "# 逆向笔记\n\n改过的内容。")
    second = e.ingest()
    assert (second["indexed"], second["skipped"], second["deleted"]) == (1, 1, 1)
    assert {r.source_path for r in e.search("RegisterNatives").collect()} == {"corpus/sample.docx"}
    assert e.search("设备指纹").count() == 0
    after = {r.source_path: (r.created_at, r.updated_at) for r in e.store.read("documents").collect()}
    path = "corpus/逆向 笔记.md"
    assert after[path][0] == created[path] < after[path][1]
    assert {r["name"]: r["rows"] for r in e.status().collect()}["documents"] == 2
    assert e.outline("sample").collect()[0].section == "intro"
    assert e.show("sample", limit=1).count() == 1
    assert [r.chunk_count for r in e.list_documents().collect()] == [1, 1]
    assert e.ingest(full=True)["indexed"] == 2


def test_one_changed_file_rewrites_one_bucket(spark, root):
    for i in range(12):
        write(root, f"n{i}.md", f"# Note {i}\n\nbody number {i} of the notes")
    e = Engine(spark, str(root))
    e.ingest()
    before = e.store.pointer()["tables"]
    assert len(before["documents"]) > 4
    write(root, "n3.md", "# Note 3\n\nanother body")
    out = e.ingest()
    after = e.store.pointer()["tables"]
    assert (out["indexed"], out["skipped"], out["chunks"]) == (1, 11, 1)
    for t in ("documents", "chunks", "postings", "lengths", "terms"):
        assert len([b for b in after[t] if after[t][b] != before[t].get(b)]) == 1, t
    assert e.store.read("documents").count() == 12 and e.search("another").count() == 1
    assert e.search("body", top_k=20).count() == 12
    versions = lambda: {p.name for p in (root / "data/index").iterdir() if p.is_dir()}
    assert len(versions()) == 2
    for i in (1, 2):
        write(root, "n3.md", f"# Note 3\n\nbody again {i}")
        e.ingest()
    assert len(versions()) <= 4  # what no pointer names is gone
    nothing = e.ingest()
    assert nothing["indexed"] == 0 and nothing["skipped"] == 12 and e.search("body", top_k=20).count() == 12


def test_images(spark, root):
    page = write(root, "sample.html", f"<title>t</title><p>text</p><img src='{PNG}' alt='图'>")
    e = Engine(spark, str(root))
    e.ingest()
    image, = (root / "data/images").rglob("*.png")
    row, = e.media().collect()
    assert os.path.join(root, row.local_path) == str(image)
    image.with_name(image.name + ".ocr.txt").write_text("read text")
    e.ingest(full=True)
    assert "ocr=read text" in e.store.read("chunks").first().text
    page.unlink()
    out = e.ingest()
    assert out["deleted"] == 1 and out["media_deleted_files"] >= 1 and out["media_deleted_entries"] == 1
    assert not list((root / "data/images").rglob("*.png")) and e.media().count() == 0


def test_command_line(spark, root, capsys):
    write(root, "a.txt", "native bridge notes")
    assert cli.main([str(root), "ingest"]) == 0
    assert cli.main([str(root), "search", "bridge", "--context", "1"]) == 0
    assert "[bridge]" in capsys.readouterr().out
    for args in (["docs", "list"], ["docs", "outline", "a"], ["docs", "show", "a"], ["media", "list"], ["status"]):
        assert cli.main([str(root), *args]) == 0
    assert "documents: 1" in capsys.readouterr().out


def test_streaming(spark, root):
    write(root, "a.md", "# One\n\ntext one")
    write(root, "broken.docx", b"not a zip")
    out, state = str(root / "out"), str(root / "state")
    streaming.start(spark, str(root / "corpus"), str(root), out, state, availableNow=True).awaitTermination(120)
    write(root, "b.md", "# Two\n\ntext two")
    streaming.start(spark, str(root / "corpus"), str(root), out, state, availableNow=True).awaitTermination(120)
    got = spark.read.parquet(f"{out}/chunks").collect()
    assert sorted(r.section for r in got) == ["One", "Two"]
    read = {t: spark.read.parquet(f"{out}/{t}") for t in ("postings", "lengths", "terms", "failed")}
    hits = search.bm25_postings(read["postings"], read["lengths"], spark.read.parquet(f"{out}/chunks"), "two", top_k=5)
    assert [r.section for r in hits.collect()] == ["Two"] and read["failed"].count() == 1 and read["terms"].count() > 2
