import numpy as np

from loamgrid.llm import url_filter as U


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = []
    for rule, verdict in U.RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, "allow")


URLS = [None, "", "no scheme", "http://", "https://WWW.Example.ORG/es/1?x#y", "http://a.example.org/en/12", "http://a.example.org/en/2", "http://notexample.org/es/", "http://x.com/de/1", "http://x.com/fr/", "http://com/de/", "http://x.com?/de/", "http://x.com#/de/", "http://example.org", "http://example.org:80/es/", "ftp://é.org/ü", "http://a://b.org/", "http://org./", "http://x.com/de", "http://.org/"]


def test_verdicts_match_the_rules_written_out(spark):
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS)] + [(None, "http://x.com/de/z", "x", "y"), (4, URLS[4], "x", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge(df).collect()), key=repr)
    assert got == sorted(((i, *plain(u)) for i, u, *_ in rows), key=repr)


def test_collisions_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(U, "digest", lambda keys: np.array([len(k) % 2 for k in keys], np.uint64))
    U.DigestArray.build([("aa", 1), ("bb", 2), ("c", 3), ("aa", 4)], str(tmp_path / "d"))
    a = U.DigestArray.open(str(tmp_path / "d"))
    found = a.probe([b"bb", b"dd", b"c", b"e", b"aa"])
    assert [None if k < 0 else (a.string(k), int(a.values[k])) for k in found] == [(b"bb", 2), None, (b"c", 3), None, (b"aa", 4)]


def test_empty_list_and_empty_table(spark, tmp_path):
    U.DigestArray.build([], str(tmp_path / "e"))
    assert (U.DigestArray.open(str(tmp_path / "e")).probe([b"x"]) == -1).all()
    one = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert U.judge(one, rules=(), default="block").first()["verdict"] == "block"
    assert U.judge(one.limit(0)).count() == 0


def test_a_list_in_several_files_finds_the_same(tmp_path):
    entries = [(f"h{i}.org/{i % 7}", i % 250) for i in range(3000)]
    whole = [U.DigestArray.open(p) for p in U.DigestArray.build(entries, str(tmp_path / "one"))]
    paths = U.DigestArray.build(entries, str(tmp_path / "many"), 4000)
    many = [U.DigestArray.open(p) for p in paths]
    assert len(whole) == 1 and len(many) > 10 and all(p.stat().st_size <= 4000 for p in tmp_path.glob("many.*"))
    keys = [k.encode() for k, _ in entries[::3]] + [b"absent", b""]
    say = lambda arrays: [None if h is None else (arrays[h[0]].string(h[1]), int(arrays[h[0]].values[h[1]])) for h in U.probe_all(arrays, keys)]
    assert say(whole) == say(many) == [(k.encode(), v) for k, v in entries[::3]] + [None, None]
    assert U.probe_all([U.DigestArray.open(p) for p in U.DigestArray.build([], str(tmp_path / "none"))], keys) == [None] * len(keys)
