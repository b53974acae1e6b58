import datetime as dt
import random
import re

from driftglass.llm.url_filter import judge_captures

DAY = dt.datetime(2024, 1, 1)


def brute(captures, entries):
    history = {}
    for p, a, d in entries:
        if p is not None and a is not None and d is not None:
            days = history.setdefault(p.strip().lower(), {})
            days[d] = max(a, days.get(d, ""))
    out = []
    for i, url, t in captures:
        found = re.match(r"[a-z][a-z0-9+.-]*://([^/?#]*)", (url or "").lower())
        best = None
        host = found[1].rpartition("@")[2].partition(":")[0].removesuffix(".") if found else ""
        if host and t and len(host) <= 253:
            labels = host.split(".")
            part = re.match(r"[a-z][a-z0-9+.-]*://[^/?#]+/([^/?#]+)", url.lower())
            for k in range(len(labels)):
                host = ".".join(labels[k:])
                for p in [host] + ([f"{host}/{part[1]}"] if part else []):
                    before = [d for d in history.get(p, {}) if d <= t]
                    if before and history[p][max(before)] != "remove":
                        best = max(best or (0,), (len(p), p, history[p][max(before)], max(before)))
        out.append((i, url, t, *(best[1:] if best else (None, None, None))))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    r = random.Random(2)
    hosts = ["a.example.com", "b.a.example.com", "example.com", "news.test", "x.y.z.news.test", "1.2.3.4.5.6.7.news.test"]
    urls = [f"{s}://{h}{p}" for s in ("http", "HTTPS") for h in hosts for p in ("", "/", "/en/1", "/EN/2?x=1", ":80/en", "?q", "#en/3")]
    day = lambda: DAY + dt.timedelta(days=r.randrange(400))
    captures = [(i, "http://a.example.com/en/1" if i % 3 == 0 else r.choice(urls), day() + dt.timedelta(hours=r.randrange(24))) for i in range(300)]
    captures += [(1, None, day()), (2, "no url", day()), (3, urls[0], None), (None, urls[0], day()), captures[0], (4, "http://u:p@a.example.com/", day())]
    captures += [(5, f"http://{x}/en", day()) for x in ("u:p@w@example.com", "EXAMPLE.com.", "other.test:80@a.example.com.:443", "u@", "@news.test", "news.test:") for _ in range(5)]
    entries = [(r.choice([*hosts, "com", "example.com/en", "A.example.com/en "]), r.choice(["block", "allow", "remove"]), day()) for _ in range(60)]
    entries += [(None, "block", day()), ("com", None, day()), ("com", "block", None)]
    got = judge_captures(spark.createDataFrame([(*x, "z") for x in captures], "capture_id long, url string, fetched_at timestamp, pattern string"), spark.createDataFrame(entries, "pattern string, action string, added_on timestamp"))
    got = sorted(map(tuple, got.collect()), key=str)
    assert got == brute(captures, entries) and sum(x[3] is not None for x in got) > 50


def test_deep_hosts_and_far_days(spark):
    deep = ".".join("abcdefghij") + ".example.com"
    long = "http://" + ".".join(["a" * 50] * 6) + ".example.com/"
    urls = [f"http://{deep}/x", f"http://{deep}/en/1", long, "http://www.example.com/"]
    captures = [(i, u, t) for i, (u, t) in enumerate((u, t) for u in urls for t in (DAY, dt.datetime(1900, 1, 1), dt.datetime(9999, 12, 1)))]
    entries = [("example.com", "block", dt.datetime(1850, 1, 1)), ("j.example.com/en", "allow", DAY), ("www.example.com", "remove", DAY), ("www.example.com", "review", dt.datetime(9000, 1, 1))]
    got = judge_captures(spark.createDataFrame(captures, "capture_id long, url string, fetched_at timestamp"), spark.createDataFrame(entries, "pattern string, action string, added_on timestamp"))
    got = sorted(map(tuple, got.collect()), key=str)
    assert got == brute(captures, entries)
    assert [x[4] for x in sorted(got)] == ["block"] * 3 + ["allow", "block", "allow"] + [None] * 3 + ["block", "block", "review"]


def test_empty_tables(spark):
    captures = spark.createDataFrame([(1, "http://a.b/", DAY)], "capture_id long, url string, fetched_at timestamp")
    entries = spark.createDataFrame([("b", "block", DAY)], "pattern string, action string, added_on timestamp")
    assert judge_captures(captures.limit(0), entries).count() == 0
    assert judge_captures(captures, entries.limit(0)).collect()[0].action is None
    assert judge_captures(captures, entries).collect()[0].action == "block"
