"""Archives by member: what is read, split among tasks, pushed down, and reported as an error."""

from __future__ import annotations

import http.server
import random
import threading
import zipfile

import pytest
from lintel.sources import archives
from pyspark.sql.datasource import EqualTo, In, StringContains, StringStartsWith


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("archives")
    noise = random.Random(1)
    with zipfile.ZipFile(base / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(40):
            z.writestr(f"top/src/f{i:02d}.py", f"x{i} = '" + "".join(noise.choices("abcdefghij", k=20_000)) + "'\n")
        z.writestr("top/src/K.java", "class K {}\n")
        z.writestr("top/readme.md", "none of ours")
        z.writestr("top/../../evil.py", "x = 1")
    with zipfile.ZipFile(base / "b.zip", "w") as z:
        z.writestr("one/a.py", b"\xff = 1\n")
        z.writestr("two/b.c", "int a;\n")
    (base / "broken.zip").write_bytes(b"PK no archive")
    (base / "other.txt").write_text("no archive")
    return base


def test_members_and_errors(spark, folder):
    rows = {(r["archive"].rsplit("/", 1)[-1], r["path"]): r for r in archives.members(spark, f"{folder}/*.zip").collect()}
    assert len(rows) == 40 + 1 + 1 + 2 + 1
    assert rows["a.zip", "top/../../evil.py"]["error"] == "path leaves the archive"
    assert rows["broken.zip", None]["error"] and rows["broken.zip", None]["text"] is None
    assert (rows["b.zip", "one/a.py"]["text"], rows["b.zip", "two/b.c"]["language"]) == ("� = 1\n", "c")
    assert archives.members(spark, str(folder / "nothing")).count() == 0
    assert archives.members(spark, str(folder / "b.zip"), largest_member=5).filter("error = 'too large'").count() == 2
    assert archives.members(spark, str(folder / "b.zip"), text="false").filter("text IS NOT NULL").count() == 0


def test_split_archives_give_each_member_once(spark, folder):
    whole = archives.members(spark, f"{folder}/a.zip")
    split = archives.members(spark, f"{folder}/a.zip", split_bytes=30_000)
    assert split.rdd.getNumPartitions() > 5 and sorted(whole.collect()) == sorted(split.collect())


def test_filters_reach_the_directory(spark, folder):
    df = archives.members(spark, str(folder)).filter("path = 'src/f07.py' AND language = 'python'")
    assert [r["text"][:4] for r in df.collect()] == ["x7 ="]
    reader = archives.ZipReader({"path": str(folder / "a.zip")})
    filters = [EqualTo(("path",), "src/f01.py"), In(("language",), ("python", "c")), StringStartsWith(("archive",), "/none"), StringContains(("path",), "f"), EqualTo(("size",), 3)]
    assert list(reader.pushFilters(filters)) == filters
    assert reader.wanted["path"].holds("src/f01.py") and not reader.wanted["path"].holds("src/f02.py") and not reader.wanted["archive"].holds("/a.zip")
    assert [p.of for p in reader.partitions()] == [0]


class Ranges(http.server.BaseHTTPRequestHandler):
    """Answers range requests for files of a folder and counts the bytes."""

    folder, served = None, []

    def do_GET(self):
        file = self.folder / self.path.rsplit("/", 1)[-1]
        if not file.exists():
            return self.send_error(404)
        data = file.read_bytes()
        a, b = self.headers["Range"].removeprefix("bytes=").split("-")
        part = data[int(a) : int(b) + 1]
        self.served.append(len(part))
        self.send_response(206)
        self.send_header("Content-Range", f"bytes {a}-{int(a) + len(part) - 1}/{len(data)}")
        self.send_header("Content-Length", str(len(part)))
        self.end_headers()
        self.wfile.write(part)

    def log_message(self, *args):
        pass


@pytest.fixture
def server(folder):
    Ranges.folder, Ranges.served = folder, []
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Ranges)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_web_archives_by_ranges(spark, folder, server, monkeypatch):
    df = archives.members(spark, f"{server}/a.zip").filter("path = 'src/f33.py'")
    assert df.first()["text"].startswith("x33 =")
    assert archives.members(spark, f"{server}/a.zip, {server}/missing.zip").filter("path IS NULL").first()["error"].startswith("HTTP Error 404")
    assert archives.members(spark, f"{server}/a.zip", largest_archive=1000).first()["error"] == "too large"
    Ranges.served.clear()
    monkeypatch.setattr(archives, "BUFFER", 4096)
    reader = archives.ZipReader({"path": f"{server}/a.zip"})
    list(reader.pushFilters([EqualTo(("path",), "src/f33.py")]))
    (row,) = reader.rows(reader.partitions()[0])
    assert row[5].startswith("x33 =") and sum(Ranges.served) < (folder / "a.zip").stat().st_size / 5


def test_first_branch_that_exists(spark, folder, server):
    (folder / "develop.zip").write_bytes((folder / "b.zip").read_bytes())
    assert archives.snapshot(spark, server + "/{}.zip").count() == 2
    assert archives.snapshot(spark, server + "/{}.zip", ("main", "trunk")).first()["error"].startswith("trunk: HTTP Error 404")


def test_written_archives_are_read_again(spark, tmp_path):
    rows = [(1, "p/a.py", "x = 1\n"), (1, "p/b.c", None), (2, "q/c.java", "é")]
    made = archives.write_archives(spark.createDataFrame(rows, "n int, path string, text string"), str(tmp_path / "out"), "n").collect()
    assert {(r["archive"].rsplit("/", 1)[-1], r["members"]) for r in made} == {("1.zip", 2), ("2.zip", 1)}
    found = {(r["path"], r["text"]) for r in archives.members(spark, str(tmp_path / "out")).collect()}
    assert found == {("a.py", "x = 1\n"), ("b.c", ""), ("c.java", "é")}
