"""Ready bundles: status files are opened in waves, and none behind the limit. Delimited files by the names of their header."""

import pytest

from townscribe.sources import files


def status(at, name, text, poisoned=False):
    (at / name).mkdir(parents=True)
    (at / name / "status.json").write_text(text)
    if poisoned:  # a checksum that no content has: the file can be listed, but not read
        (at / name / ".status.json.crc").write_bytes(b"crc\x00\x00\x00\x02\x00" + bytes(range(1, 5)))


def test_files_behind_the_limit_are_not_opened(spark, tmp_path, monkeypatch):
    at, opened = tmp_path / "in", []
    for i in range(40):
        status(at, f"b{i:02} [x]", f'{{"status": "{"ready" if i % 3 == 0 else "failed"}", "bundle_id": "{i}"}}' if i % 5 != 4 else "no json", poisoned=i >= 12)
    true = files._status
    monkeypatch.setattr(files, "_status", lambda s, *paths: opened.append(len(paths)) or true(s, *paths))

    def ids(*a):
        return [r["bundle_id"] for r in files.read_ready_bundles(spark, f"{at}/*/status.json", *a).collect()]

    # ready are 0, 3, 6, 12, 15, ... (9 is no JSON): waves of 4 and 8 files give the first three
    assert ids(3, 4) == ["0", "3", "6"] and opened == [4, 8]
    opened.clear()
    assert ids(2) == ["0", "3"] and opened == [8]
    with pytest.raises(Exception, match="(?i)checksum"):
        ids(4, 4)


def test_all_or_fewer_than_asked_for(spark, tmp_path):
    for i in range(5):
        status(tmp_path / "in", f"b{i}", f'{{"status": "{"ready" if i % 2 else "failed"}", "bundle_id": "{i}"}}')
    path = f"{tmp_path}/in/*/status.json"
    for limit, wave in ((9, 1), (9, None), (2, 2), (None, None)):
        got = files.read_ready_bundles(spark, path, limit, wave)
        assert sorted((r["bundle_id"], r["prefix"].rsplit("/", 1)[1]) for r in got.collect()) == [("1", "b1"), ("3", "b3")]
    assert files.read_ready_bundles(spark, path, 0).count() == 0


def test_delimited_files_by_name(spark, tmp_path):
    at = tmp_path / "in"
    at.mkdir()
    (at / "a.csv").write_bytes(b'\xef\xbb\xbfNAME,id,more,when\n"Elm, ""old""",1,x,2024-01-02\nBad \xff\xfe byte,two,y,never\n,3\n')
    kind = "id int, name string, `when` date, gone double"
    got = [tuple(map(str, r)) for r in files.read_csv(spark, str(at), kind).collect()]
    assert got == [("1", 'Elm, "old"', "2024-01-02", "None"), ("None", "Bad \ufffd\ufffd byte", "None", "None"), ("3", "None", "None", "None")]
    assert files.read_csv(spark, str(at), kind).schema.simpleString() == "struct<id:int,name:string,when:date,gone:double>"
    (at / "b.csv").write_text("id,NAME,more,when\n4,other order,z,\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_csv(spark, str(at), kind).collect()
    (tmp_path / "q.csv").write_text('id|name\n1|"two\nlines"\n')
    assert [r["name"] for r in files.read_csv(spark, f"{tmp_path}/q.csv", "id int, name string", "|", True).collect()] == ["two\nlines"]
    (tmp_path / "e.csv").write_text("")
    assert files.read_csv(spark, f"{tmp_path}/e.csv", "id int").count() == 0


def test_folders_behind_the_limit_are_not_listed(spark, tmp_path, monkeypatch):
    for i in range(60):
        status(tmp_path / "in" / f"g{i // 10}", f"b{i:02}", f'{{"status": "{"ready" if i % 2 else "failed"}", "bundle_id": "{i}"}}')
    true, listed = files._names, []
    monkeypatch.setattr(files, "_names", lambda s, at, part: listed.append(at) or true(s, at, part))
    got = [r["bundle_id"] for r in files.read_ready_bundles(spark, f"{tmp_path}/in/*/*/status.json", 2).collect()]
    assert got == ["1", "3"]
    assert len(listed) == 10 and not any("/g1" in at for at in listed)  # the root, the first group, and eight of its bundles


def test_order_is_that_of_whole_paths(spark, tmp_path):
    names = ["a", "a-b", "a b", "a!b", "a0", "a.c", "ä", "[x]", "{y,z}"]
    for n in names:
        status(tmp_path / "in", n, f'{{"status": "ready", "bundle_id": "{n}"}}')
        (tmp_path / "in" / n / "_status.json").write_text(f'{{"status": "ready", "bundle_id": "hidden {n}"}}')
    want = sorted(names, key=lambda n: n + "/")
    for path in (f"{tmp_path}/in/*/*.json", f"{tmp_path}/in/{{a*/status.json,*/status.json}}"):
        for limit, wave in ((1, 1), (1, None), (3, 1), (3, None), (9, 2), (20, None)):
            assert [r["bundle_id"] for r in files.read_ready_bundles(spark, path, limit, wave).collect()] == want[:limit]
    with pytest.raises(Exception, match="(?i)path"):
        files.read_ready_bundles(spark, f"{tmp_path}/gone/*/status.json", 2)


def test_statuses_are_written_by_tasks(spark, tmp_path):
    rows = spark.createDataFrame([(f"{str(i)[:2]}/{i}", f'{{"bundle_id": "{i}", "status": "ready"}}') for i in range(300)], "prefix string, json string")
    files.write_statuses(rows, f"{tmp_path}/a b")
    found = sorted(str(p.relative_to(tmp_path / "a b")) for p in (tmp_path / "a b").rglob("*") if p.is_file())
    assert found == sorted(f"{str(i)[:2]}/{i}/status.json" for i in range(300))
    got = [r["bundle_id"] for r in files.read_ready_bundles(spark, f"{tmp_path}/a b/*/*/status.json", 40).collect()]
    assert got == sorted(map(str, range(300)))[:40]
