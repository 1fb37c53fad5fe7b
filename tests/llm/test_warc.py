import random

from pyspark.sql import functions as F

from tesselune.llm.warc import NOT_MODIFIED, PERMITTED, RECORDS, canonical_url, read_warc, resolve_revisits, write_warc


def test_canonical_urls(spark):
    cases = {
        "HTTP://WWW.Example.org:80/a/?utm_source=x#top": "example.org/a",
        "https://example.org/a": "example.org/a",
        "https://user:pw@example.org/A?b=2&a=1&UTM_x=1": "example.org/A?a=1&b=2",
        "http://example.org:8080?x": "example.org:8080?x",
        "https://www2.example.org": "example.org",
        "": "",
        None: None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "u string").select("u", canonical_url(F.col("u")).alias("c")).collect()
    assert {r.u: r.c for r in rows} == cases


def records(n=400):
    rng, out = random.Random(8), []
    for i in range(n):
        url = rng.choice(["http://a.org/x", "https://www.a.org/x/", "http://a.org/y", None, "http://hot.org/"])
        if rng.random() < 0.4:
            out.append((f"r{i:04}", "response", url, rng.randrange(60), None, rng.choice([200, 200, 404]), {"etag": rng.choice(['"1"', '"2"']), "last-modified": rng.choice("ab"), "server": "s"}, b"p"))
        else:
            head = rng.choice([{"etag": 'W/"1"', "server": "t"}, {"etag": '"2"', "date": "d"}, {"last-modified": "a", "vary": "v"}, {}, None])
            out.append((f"r{i:04}", "revisit", url, rng.randrange(60), rng.choice([NOT_MODIFIED, NOT_MODIFIED, "http://other"]), 304, head, None))
    return out


def canon(url):
    return url and url.split("//")[1].removeprefix("www.").rstrip("/")


def brute(rows):
    out = {}
    for rid, kind, url, ts, profile, _, head, _ in rows:
        if kind != "revisit" or profile != NOT_MODIFIED:
            continue
        full = [r for r in rows if r[1] == "response" and r[5] == 200 and url and canon(r[2]) == canon(url) and (r[3], r[0]) < (ts, rid)]
        if not full:
            out[rid] = ("no_response", None, None)
            continue
        target, head = max(full, key=lambda r: (r[3], r[0])), head or {}
        if "etag" in head:
            outcome = "resolved" if head["etag"].removeprefix("W/") == target[6]["etag"] else "changed"
        elif "last-modified" in head:
            outcome = "resolved" if head["last-modified"] == target[6]["last-modified"] else "changed"
        else:
            outcome = "unverified"
        merged = target[6] | {k: v for k, v in head.items() if k in PERMITTED} if outcome == "resolved" else target[6]
        out[rid] = (outcome, target[0], merged)
    return out


def test_equal_to_brute_force_with_and_without_hot_urls(spark):
    rows = records()
    df = spark.createDataFrame(rows, RECORDS).withColumn("target", F.lit(1)).repartition(4)
    for hot in (50_000, 5):
        got = {r.record_id: (r.outcome, r.target_id, r.headers) for r in resolve_revisits(df, hot).collect()}
        assert got == brute(rows)
    assert resolve_revisits(df.limit(0)).count() == 0


def test_files_round_trip(spark, tmp_path):
    rows = [(f"<urn:{i}>", *r[1:6], r[6], r[7] or b"") for i, r in enumerate(records(40))] + [("<urn:x>", "response", "http://é.org/", 5, None, 200, {"a": "b: c"}, b"\r\n\r\nWARC/1.1\r\n" + bytes(range(256)))]
    df = spark.createDataFrame(rows, RECORDS).repartition(3)
    for zipped in (True, False):
        files = write_warc(df, f"file://{tmp_path}/{zipped}", zipped)
        back = read_warc(spark, [r.path for r in files.collect()]).collect()
        assert sorted((r.record_id, r.type, r.url, r.ts, r.profile, r.status, tuple(sorted((r.headers or {}).items())), bytes(r.payload)) for r in back) == sorted(
            (*r[:6], tuple(sorted((r[6] or {}).items())), r[7]) for r in rows
        )
    assert read_warc(spark, []).count() == 0


def test_bad_lengths_and_dates(spark, tmp_path):
    def record(i, date, length, block):
        return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <{i}>\r\nWARC-Date: {date}\r\nContent-Length: {length}\r\n\r\n{block}\r\n\r\n"

    text = record(1, "soon", 3, "abc") + record(2, "2020-01-01T00:00:00Z", "many", "lost") + record(3, "2020-01-01T00:00:01Z", 2, "ok") + record(4, "", -1, "x")
    (tmp_path / "a.warc").write_text(text, newline="")
    got = {r.record_id: (r.ts, bytes(r.payload)) for r in read_warc(spark, [f"file://{tmp_path}/a.warc"]).collect()}
    assert got == {"<1>": (None, b"abc"), "<2>": (1577836800, b""), "<3>": (1577836801, b"ok"), "<4>": (None, b"")}


def test_records_without_a_time_meet_nothing(spark):
    rows = [("a", "response", "http://x/", None, None, 200, {}, None), ("b", "revisit", "http://x/", 5, NOT_MODIFIED, 304, {}, None), ("c", "response", "http://x/", 1, None, 200, {}, None), ("d", "revisit", "http://x/", None, NOT_MODIFIED, 304, {}, None)]
    got = {r.record_id: (r.outcome, r.target_id) for r in resolve_revisits(spark.createDataFrame(rows, RECORDS), 1).collect()}
    assert got == {"b": ("unverified", "c"), "d": ("no_response", None)}
