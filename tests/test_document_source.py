"""The data source of contract files: what it lists, how it deals files, what it rejects."""

import os
import zipfile

import pytest


@pytest.fixture
def source(spark):
    from pactum.sources import document_source

    document_source.register(spark)
    return document_source


def load(spark, path, **options):
    return spark.read.format("contract_files").options(**options).load(str(path))


def test_every_file_gives_a_row(spark, source, tmp_path):
    """Pages, rejects and other kinds, files without a byte and files that can't be opened; the same rows as pages_of_files where both read."""
    from pactum.sources import files

    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    (tmp_path / "deep" / "deeper").mkdir(parents=True)
    with zipfile.ZipFile(tmp_path / "deep" / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>fine</w:t></w:r></w:p></w:body></w:document>')
    for name, content in {"b.docx": b"no zip", "c.txt": b"x \xff y", "deep/c.txt": b"other", "deep/deeper/d.PDF": b"%PDF", "e.exe": b"x", "f": b"x"}.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "deep" / "_SUCCESS.txt").write_text("x")
    (tmp_path / ".hidden.txt").write_text("x")
    cut = lambda df: sorted((r["path"].split(tmp_path.name + "/")[1], r["kind"], r["page_number"], r["text"], r["source"], r["confidence"], r["error"]) for r in df.collect())
    got = cut(load(spark, tmp_path))
    assert got == cut(files.read_documents(spark, str(tmp_path))) and len(got) == 7
    assert got == cut(load(spark, f"file://{tmp_path}")) == cut(load(spark, tmp_path, splitBytes=1))
    (tmp_path / "empty.txt").touch()
    (tmp_path / "empty.docx").touch()
    os.symlink(tmp_path / "nowhere.txt", tmp_path / "gone.txt")
    more = {r["path"].rsplit("/", 1)[1]: (r["kind"], r["text"], r["error"]) for r in load(spark, tmp_path).collect()}
    assert more["empty.txt"] == ("page", "", None) and more["empty.docx"] == ("reject", None, files.NO_ZIP)
    assert more.get("gone.txt", ("reject",))[0] == "reject"


def test_a_file_that_goes_away_is_a_reject(source, tmp_path):
    (tmp_path / "a.txt").write_text("here")
    reader = source.ContractFilesReader({"path": str(tmp_path)})
    (part,) = reader.partitions()
    (tmp_path / "a.txt").unlink()
    (row,) = [r for batch in reader.read(part) for r in batch.to_pylist()]
    assert row["kind"] == "reject" and row["error"] == "File can't be opened: FileNotFoundError" and row["path"].endswith("a.txt")


def test_names_folders_and_nothing(spark, source, tmp_path):
    for folder in ("one", "two", "none"):
        (tmp_path / folder).mkdir()
    for k in range(6):
        (tmp_path / ("one", "two")[k % 2] / f"{'draft' if k < 3 else 'final'}-{k}.txt").write_text(str(k))
    assert sorted(r["text"] for r in load(spark, tmp_path, pathGlobFilter="draft-*").collect()) == ["0", "1", "2"]
    both = spark.read.format("contract_files").option("paths", f"{tmp_path}/one, {tmp_path}/two, {tmp_path}/one").load()
    assert sorted(r["text"] for r in both.collect()) == list("012345")
    assert load(spark, tmp_path / "one" / "draft-0.txt").first()["text"] == "0"
    assert load(spark, tmp_path / "none").count() == 0
    with pytest.raises(Exception, match="nowhere"):
        load(spark, tmp_path / "nowhere").count()


def test_files_are_dealt_by_bytes(source):
    """Every file once; no partition has more than the split and one file; a large file stands by itself."""
    mb = 1 << 20
    files = [(f"f{k}", size) for k, size in enumerate([900 * mb, *[3 * mb] * 50, *[0] * 500, 70 * mb])]
    parts = source.dealt(files, 64 * mb)
    assert sorted(p for part in parts for p in part.paths) == sorted(name for name, _ in files)
    size = dict(files)
    loads = [sum(size[p] + source.OPEN_BYTES for p in part.paths) for part in parts]
    assert ["f0"] in [part.paths for part in parts] and sorted(loads)[-2] <= 64 * mb + 70 * mb
    assert source.dealt([], 64 * mb) == []


def test_a_large_text_is_whole(spark, source, tmp_path):
    text = "một hai ba " * 1_000_000
    (tmp_path / "long.txt").write_text(text)
    (tmp_path / "short.txt").write_text("x")
    assert sorted(len(r["text"]) for r in load(spark, tmp_path).collect()) == [1, len(text)]


def test_tables_of_a_block_go_with_it(spark, tmp_path):
    """What operators write for themselves is removed at the block's end, also after an error; results written elsewhere stay."""
    from pactum.operators.common import stash
    from pactum.plans import catalog
    from pactum.sources import files

    sf = "/root/testdata/sf0.001"
    base = files.shared_path(spark, "x").rsplit("/", 1)[0]
    stay = stash(spark.range(3), "stay")
    before = files.children(spark, base)
    with files.scratch(spark):
        catalog.QUERIES["document_json_sink"](spark, sf).write.parquet(f"file://{tmp_path}/out")
        inner_before = set(files.children(spark, base))
        with files.scratch(spark):
            assert stash(spark.range(5), "inner").count() == 5
        assert set(files.children(spark, base)) == inner_before > set(before)
    with pytest.raises(ZeroDivisionError), files.scratch(spark):
        stash(spark.range(2), "failing")
        1 / 0  # noqa: B018
    assert files.children(spark, base) == before and stay.count() == 3
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == catalog.QUERIES["document_json_sink"](spark, sf).count()
