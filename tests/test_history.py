"""The reference's offline cases, the cases it lacks, and randomised comparison with a brute-force model."""

import datetime as dt
import gzip
import ipaddress
import json
import lzma
import random
import threading
import urllib.error
import urllib.request
from http.server import ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from originlake import cli, http_api, model
from originlake.functions.dates import strict_date
from originlake.functions.prefix import parse_cidr, with_ancestors, with_prefix_key
from originlake.operators import history as H
from originlake.operators import index as I
from originlake.operators import query as Q
from originlake.sources import dumps, jsonl, store
from originlake.streaming import updater

D0 = dt.date(2024, 1, 1)
F1 = [("1.0.0.0/8", 64512, 8), ("1.1.1.0/24", 13335, 24), ("1.1.1.0/25", 64513, 25)]
V6 = [("2001:db8::/32", 64600, 48), ("::/0", 64601, 0), ("0.0.0.0/0", 64602, 0), ("2001:db8::1/128", 64603, 128)]


def obs(spark, rows):
    """(prefix, asn, max_len[, date]) rows as observations."""
    full = [("apnic", p, m, a, d[0] if d else D0) for p, a, m, *d in rows]
    return updater.observations_from_rows(spark.createDataFrame(full, model.OBS_SCHEMA))


def stored(spark, rows):
    return I.with_roots(H.build_history(obs(spark, rows)))


def names(df):
    return {(r["prefix"], r["origin"]) for r in df.select("prefix", "origin").collect()}


@pytest.fixture(scope="module")
def f1(spark):
    return stored(spark, F1).cache()


def test_search_cases(f1):
    assert names(Q.search(f1, "1.1.1.0/24")) == {("1.1.1.0/24", 13335)}
    assert names(Q.search(f1, "1.1.1.0/24", exact=False)) == {(p, a) for p, a, _ in F1}
    assert names(Q.search(f1, "2.2.2.0/24")) == set() and Q.search(f1).count() == 3
    assert Q.lookup_prefix(f1, "1.1.1.0/24").count() == 3
    assert names(Q.search(f1, "1.1.1.77/24")) == {("1.1.1.0/24", 13335)}  # the canonical stored prefix
    for bad in ("1.1.1.0", "1.1.1.0/33", "x/8", "", "1.1.1.0/2x"):
        with pytest.raises(ValueError, match="invalid prefix"):
            Q.search(f1, bad)
    with pytest.raises(ValueError, match="invalid date"):
        Q.search(f1, date="2022-1")


def test_validate_cases(f1):
    assert Q.validate_one(f1, "1.1.1.0/24", 13335, D0)["result"] == "valid"
    assert Q.validate_one(f1, "1.1.1.0/24", 64512, D0)["result"] == "invalid"
    assert Q.validate_one(f1, "9.9.9.0/24", 13335)["result"] == "unknown"
    assert Q.validate_one(f1, "1.1.1.0/24", 13335, "2023-01-01")["result"] == "invalid"


def test_siblings_and_missing_cover(spark):
    h = stored(spark, [*F1, ("1.2.0.0/16", 65000, 24)]).cache()
    assert ("1.2.0.0/16", 65000) in names(Q.search(h, "1.1.1.0/24", exact=False))
    assert ("1.2.0.0/16", 65000) not in names(Q.search(h, "1.1.1.0/24", exact=False, mode="related"))
    assert Q.validate_one(h, "1.1.1.0/24", 65000, D0)["result"] == "valid"
    lone = stored(spark, [("1.1.1.0/25", 1, 25)])
    assert Q.search(lone, "1.1.1.0/24", exact=False).count() == 0


def test_current_expired_and_paging(spark):
    h = stored(spark, [*F1, ("8.8.8.0/24", 15169, 24, dt.date(2024, 3, 1))]).cache()
    assert names(Q.search(h, current=True, date="1999-01-01")) == {("8.8.8.0/24", 15169)}
    assert len(names(Q.search(h, current=False))) == 3
    p = Q.search_page(h, 0, 5000)
    assert p["total"] == 4 and p["page_size"] == 1000 and p["meta"] == {"latest_date": "2024-03-01", "format_version": 2}
    assert [d["current"] for d in p["data"]] == [False, False, False, True]
    assert Q.search_page(h, 7, 10)["data"] == [] and Q.search_page(h, 0, 0)["total"] == 4
    assert "(2024-03-01,2024-03-01)" in cli.text_table(Q.search(h, asn=15169))
    empty = h.where("false")
    assert Q.health(empty) == {"ipv4_roas_count": 0, "ipv6_roas_count": 0, "latest_date": "1970-01-01", "format_version": 2}


def test_search_command_prints_every_row(spark, tmp_path, capsys):
    h = stored(spark, [(f"10.{k // 256}.{k % 256}.0/24", 64500, 24) for k in range(1203)])
    store.publish(h, str(tmp_path / "many"))
    assert cli.main([str(tmp_path / "many"), "search", "--asn", "64500"], spark) == 0
    lines = capsys.readouterr().out.splitlines()
    assert len(lines) == 2 + 1203 and len({len(x) for x in lines}) == 1
    assert [x.split(" | ")[1].strip() for x in lines[2:]] == [f"10.{k // 256}.{k % 256}.0/24" for k in range(1203)]


def test_counts_of_both_conventions(spark):
    h = stored(spark, [("1.1.1.0/24", a, m) for a in (1, 2) for m in (24, 25)] + V6[:1])
    assert {(r["fam"], r["prefixes"], r["records"]) for r in H.counts(h).collect()} == {(4, 1, 4), (6, 1, 1)}


def test_parsing_and_order(spark):
    assert parse_cidr("0.0.0.0/0")[1:3] == (4, 0) and parse_cidr("::/0")[1:3] == (6, 0)
    assert parse_cidr("1.2.3.4/16")[0] == "1.2.0.0/16" and parse_cidr("2001:DB8::1/32")[0] == "2001:db8::/32"
    assert parse_cidr(None) is None and parse_cidr("1.2.3.4") is None and parse_cidr("1.2.3.4/-1") is None
    h = stored(spark, [*F1, *V6])
    got = [r["prefix"] for r in h.orderBy(*Q.ORDER).collect()]
    assert got == ["0.0.0.0/0", "1.0.0.0/8", "1.1.1.0/24", "1.1.1.0/25", "::/0", "2001:db8::/32", "2001:db8::1/128"]
    assert h.select("root").distinct().count() == 2
    assert strict_date("2024-02-29") == dt.date(2024, 2, 29)


def test_subtree_and_ancestors_against_ipaddress(spark):
    r = random.Random(6)

    def net(v6):
        bits = 128 if v6 else 32
        n = r.choice([3, 8, 12, 16, 17, 24, 30, 32] if not v6 else [4, 19, 32, 33, 48, 64, 127, 128])
        a = (r.randrange(8) << (bits - 5)) | (r.randrange(4) << (bits - 14)) | (r.randrange(3) << (bits - 20)) | r.randrange(1 << (bits - 24))
        return ipaddress.ip_network((a >> (bits - n) << (bits - n), n))

    own = {net(k % 2) for k in range(150)}
    asked = [net(k % 2) for k in range(120)]
    h = stored(spark, [(str(n), 1, n.prefixlen) for n in own]).cache()
    q = with_prefix_key(spark.createDataFrame([(i, str(n)) for i, n in enumerate(asked)], "qid int, prefix string"))
    inside = lambda a, b: a.version == b.version and a.subnet_of(b)
    want = set()
    for i, n in enumerate(asked):
        cover = [s for s in own if inside(n, s)]
        if cover:
            top = min(cover, key=lambda s: s.prefixlen)
            want |= {(i, str(s)) for s in own if inside(s, top)}
    assert {(x["qid"], x["prefix"]) for x in I.subtree_match(q, h).collect()} == want
    both = {(i, str(s)) for i, n in enumerate(asked) for s in own if inside(n, s) or inside(s, n)}
    assert {(x["qid"], x["prefix"]) for x in I.related_match(q, h).collect()} == both
    one = with_ancestors(q.where("qid = 0")).collect()
    assert [bytes(x["a_lo"]) for x in one] == [asked[0].supernet(new_prefix=k).network_address.packed for k in range(asked[0].prefixlen + 1)]


def ranges_of(days):
    out = []
    for d in sorted(set(days)):
        if out and (d - out[-1][1]).days == 1:
            out[-1][1] = d
        else:
            out.append([d, d])
    return [tuple(x) for x in out]


def test_history_steps_against_a_day_model(spark):
    r = random.Random(8)
    day = lambda k: dt.date(2021, 8, 1) + dt.timedelta(k)
    old, new, parts = [], [], []
    for key in range(60):
        old += [(f"10.{key}.0.0/16", 1, 16, day(k)) for k in range(22) if r.random() < 0.7]
        new += [(f"10.{key}.0.0/16", 1, 16, day(k)) for k in range(10, 30) if r.random() < 0.6]
    model_old, model_new = {}, {}
    for rows, m in ((old, model_old), (new, model_new)):
        for p, _, _, d in rows:
            m.setdefault(p, []).append(d)
    isl = H.date_islands(obs(spark, old + old))
    parse = lambda df: {k: sorted((x["start"], x["end"]) for x in v) for k, v in _by(df).items()}
    assert parse(isl) == {p: ranges_of(d) for p, d in model_old.items()}
    done = {}
    for p in {*model_old, *model_new}:
        have = list(model_old.get(p, []))
        for d in sorted(model_new.get(p, [])):
            if not have or d > max(have):
                have.append(d)
        done[p] = ranges_of(have)
    assert parse(H.append_days(isl, obs(spark, new))) == done
    full = {}
    for p, d in model_old.items():
        v = ranges_of(d)
        days = set(d)
        for a, b in zip(v, v[1:]):
            if (a[1] + dt.timedelta(1), b[0] - dt.timedelta(1)) in set(model.KNOWN_GAPS):
                days |= {a[1] + dt.timedelta(k) for k in range((b[0] - a[1]).days)}
        full[p] = ranges_of(days)
    assert parse(H.fill_known_gaps(isl)) == full and full != {p: ranges_of(d) for p, d in model_old.items()}
    assert parts == []


def _by(df):
    out = {}
    for r in df.collect():
        out.setdefault(str(ipaddress.ip_network((bytes(r["lo"]), r["plen"]))), []).append(r)
    return out


def test_gap_cases(spark):
    def fill(days):
        rows = H.fill_known_gaps(H.date_islands(obs(spark, [("1.0.0.0/8", 1, 8, dt.date.fromisoformat(d)) for d in days])))
        return sorted((str(r["start"]), str(r["end"])) for r in rows.collect())

    assert fill(["2023-06-23", "2023-06-25"]) == [("2023-06-23", "2023-06-25")]
    assert len(fill(["2021-08-05", "2021-08-11"])) == 2 and len(fill(["2023-06-23", "2023-06-26"])) == 2
    assert len(model.KNOWN_GAPS) == 76 and sum((b - a).days + 1 for a, b in model.KNOWN_GAPS) == 175
    with pytest.raises(ValueError):
        model.tal_catalog(spark, "nobody")
    assert model.tal_catalog(spark).count() == 5


def line(p, m, o, *r):
    sec = lambda d: (dt.date.fromisoformat(d) - dt.date(1970, 1, 1)).days * 86400
    return json.dumps({"p": p, "m": m, "o": o, "r": [[sec(a), sec(b)] for a, b in r]})


def test_transport(spark, tmp_path, f1):
    bad = tmp_path / "bad.jsonl"
    for text, n in (("\n{oops\n", 2), (line("1.0.0.0/8", 8, 1, ("2024-01-02", "2024-01-01")), 1), (line("1.0.0.0/8", 300, 1), 1), ("\n\n" + line("zz", 8, 1), 3)):
        bad.write_text(text)
        with pytest.raises(ValueError, match=f"line {n}$"):
            jsonl.read_jsonl(spark, str(bad))
    twice = tmp_path / "twice.jsonl"
    twice.write_text(line("1.0.0.0/8", 8, 1, ("2024-01-01", "2024-01-03")) + "\n" + line("1.0.0.0/8", 8, 1, ("2024-01-02", "2024-01-05")))
    one = jsonl.read_jsonl(spark, str(twice)).collect()
    assert [[(str(x["start"]), str(x["end"])) for x in r["ranges"]] for r in one] == [[("2024-01-01", "2024-01-05")]]
    jsonl.export_jsonl(f1, str(tmp_path / "out"), single_file=True)
    part = next((tmp_path / "out").glob("part-*.gz"))
    text = gzip.decompress(part.read_bytes()).decode().splitlines()
    assert text[0] == '{"p":"1.0.0.0/8","m":8,"o":64512,"r":[[1704067200,1704067200]]}' and len(text) == 3
    path = str(tmp_path / "store")
    assert store.bootstrap(spark, path, [str(tmp_path / "none"), str(tmp_path / "out")])
    assert not store.bootstrap(spark, path, [])
    assert names(store.open_store(spark, path)) == names(f1)
    meta = store.store_meta(spark, path)
    assert (meta["v4_prefixes"], meta["v4_records"], meta["v6_prefixes"], meta["format_version"]) == (3, 3, 0, 2)
    with pytest.raises(FileNotFoundError):
        store.open_store(spark, str(tmp_path / "nowhere"))
    src = tmp_path / "gap.jsonl"
    src.write_text(line("1.0.0.0/8", 8, 1, ("2023-06-20", "2023-06-23"), ("2023-06-25", "2023-06-26")))
    cli.fix(spark, str(src))
    assert [len(r["ranges"]) for r in jsonl.read_jsonl(spark, str(src)).collect()] == [1]


def dump(base, tal, day, *rows, head=True, name="roas.csv.xz"):
    d = base / f"{tal}.tal" / day.replace("-", "/")
    d.mkdir(parents=True)
    body = ("URI,ASN,IP Prefix,Max Length,Not Before\n" if head else "") + "".join(f"rsync://x,{a},{p},{m},y\n" for p, a, m in rows)
    (d / name).write_bytes(lzma.compress(body.encode()))


def test_dumps_updates_and_http(spark, tmp_path):
    base, path = tmp_path / "rpki", str(tmp_path / "s")
    dump(base, "apnic", "2021-03-05", ("1.0.0.0/8", "AS1", 8), ("1.0.0.0/8", "AS1", 8), ("1.1.1.0/24", "ASAS13335", ""))
    dump(base, "arin", "2021-03-05", ("2.0.0.0/8", "AS2", 9), head=False)
    dump(base, "lacnic", "2021-03-06")
    files = dumps.list_dumps(spark, str(base), since=dt.date(2020, 6, 1))
    assert {(r["tal"], str(r["file_date"])) for r in files.collect()} == {("apnic", "2021-03-05"), ("arin", "2021-03-05"), ("lacnic", "2021-03-06")}
    assert dumps.list_dumps(spark, str(base), "apnic", until=dt.date(2020, 9, 1)).count() == 0
    parsed = dumps.parse_dumps(spark, str(base)).collect()
    assert {(r["prefix"], r["max_len"], r["asn"]) for r in parsed if r["error"] is None} == {("1.0.0.0/8", 8, 1), ("1.1.1.0/24", 24, 13335)}
    assert [r["error"] for r in parsed if r["error"]] == ["data before the header"] and len(parsed) == 3
    beats = []

    def run():
        q = updater.start(spark, str(base), path, str(tmp_path / "ck"), backup_to=str(tmp_path / "bk"), heartbeat=lambda: beats.append(1))
        q.awaitTermination()

    run()
    dump(base, "apnic", "2021-03-06", ("1.0.0.0/8", "AS1", 8))
    dump(base, "apnic", "2021-03-09", ("1.0.0.0/8", "AS1", 8))
    run()
    h = store.open_store(spark, path)
    got = {r["prefix"]: [(str(x["start"]), str(x["end"])) for x in r["ranges"]] for r in h.collect()}
    assert got == {"1.0.0.0/8": [("2021-03-05", "2021-03-06"), ("2021-03-09", "2021-03-09")], "1.1.1.0/24": [("2021-03-05", "2021-03-05")]}
    assert len(beats) == 2 and jsonl.read_jsonl(spark, str(tmp_path / "bk")).count() == 2
    cli.rebuild(spark, str(tmp_path / "r"), str(base), "apnic", until=dt.date(2021, 3, 6))
    cli.update(spark, str(tmp_path / "r"), str(base))
    assert names(store.open_store(spark, str(tmp_path / "r"))) == names(h)
    assert cli.main([str(tmp_path / "r"), "search", "--asn", "1"], spark) == 0
    assert cli.main([str(tmp_path / "none"), "search"], spark) == 1

    server = ThreadingHTTPServer(("127.0.0.1", 0), http_api.handler(spark, path))
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def get(url):
        try:
            with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{url}") as f:
                return f.status, json.load(f)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    assert get("/health")[1] == {"ipv4_roas_count": 2, "ipv6_roas_count": 0, "latest_date": "2021-03-09", "format_version": 2}
    assert get("/search?prefix=1.1.1.0/24&exact=false")[1]["total"] == 2
    assert get("/validate?prefix=1.1.1.0/24&asn=13335&date=2021-03-05")[1]["result"] == "valid"
    assert get("/search?prefix=oops") == (400, {"error": "invalid prefix"}) and get("/validate?asn=1")[0] == 400 and get("/x")[0] == 404
    server.shutdown()


def test_failed_files_come_back_and_updates_go_on(spark, tmp_path, monkeypatch, caplog):
    base, path = tmp_path / "rpki", str(tmp_path / "s")
    run = lambda: updater.start(spark, str(base), path, str(tmp_path / "ck")).awaitTermination()
    dump(base, "apnic", "2021-03-05", ("1.0.0.0/8", "AS1", 8))
    dump(base, "apnic", "2021-03-06", ("1.0.0.0/8", "ASx", 8))
    dump(base, "apnic", "2021-03-07", ("1.0.0.0/8", "AS1", 8))
    run()
    ranges = lambda: [[(str(x["start"]), str(x["end"])) for x in r["ranges"]] for r in store.open_store(spark, path).collect()]
    assert ranges() == [[("2021-03-05", "2021-03-05"), ("2021-03-07", "2021-03-07")]]
    assert [p.split("/")[-2] for p in updater.failed_files(spark, path)] == ["06"]
    run()  # still bad: nothing changes
    assert len(ranges()[0]) == 2 and len(updater.failed_files(spark, path)) == 1
    bad = base / "apnic.tal/2021/03/06/roas.csv.xz"
    bad.write_bytes(lzma.compress(b"URI,ASN,IP Prefix,Max Length,Not Before\nrsync://x,AS1,1.0.0.0/8,8,y\n"))
    run()
    assert ranges() == [[("2021-03-05", "2021-03-07")]] and updater.failed_files(spark, path) == []
    # an error while a batch is applied neither ends the stream nor loses the files
    dump(base, "apnic", "2021-03-08", ("1.0.0.0/8", "AS1", 8))
    real = updater.publish
    monkeypatch.setattr(updater, "publish", lambda *_: 1 / 0)
    run()
    assert len(updater.failed_files(spark, path)) == 1 and "tried again" in caplog.text
    monkeypatch.setattr(updater, "publish", real)
    run()
    assert ranges() == [[("2021-03-05", "2021-03-08")]] and not list((tmp_path / "s" / "_staging").glob("*"))
    assert len(list((tmp_path / "s").glob("v=*"))) <= 3


def test_a_stream_that_ends_starts_again(spark, monkeypatch):
    stop, made = threading.Event(), []

    class Query:
        isActive = False

        def exception(self):
            return "gone"

        def stop(self):
            pass

    def start(*args, **options):
        made.append(args)
        if len(made) == 2:
            raise OSError("not now")
        if len(made) == 4:
            stop.set()
        return Query()

    monkeypatch.setattr(updater, "start", start)
    updater.watch(stop, 0.01, spark, "b", "s", "c", backup_to=None)
    assert len(made) == 4


def test_fix_in_place_never_loses_the_transport(spark, tmp_path, monkeypatch):
    src = tmp_path / "t.jsonl"
    src.write_text(line("1.0.0.0/8", 8, 1, ("2023-06-20", "2023-06-23"), ("2023-06-25", "2023-06-26")))
    cli.fix(spark, str(src))
    assert src.exists() and not list(tmp_path.glob("*.old")) and not list(tmp_path.glob("*.fixed"))
    src.rename(tmp_path / "t.jsonl.old")  # cut short between two renames
    cli.fix(spark, str(src))
    assert [len(r["ranges"]) for r in jsonl.read_jsonl(spark, str(src)).collect()] == [1]


def test_only_listed_files_are_opened(spark, tmp_path):
    base, path = tmp_path / "rpki", str(tmp_path / "s")
    dump(base, "apnic", "2021-03-05", ("1.0.0.0/8", "AS1", 8))
    cli.rebuild(spark, path, str(base))
    old = base / "apnic.tal/2021/03/05/roas.csv.xz"
    old.write_bytes(b"no longer readable")
    dump(base, "apnic", "2021-03-06", ("1.0.0.0/8", "AS1", 8))
    cli.update(spark, path, str(base))
    assert [str(r["ranges"][0]["end"]) for r in store.open_store(spark, path).collect()] == ["2021-03-06"]
    cli.update(spark, path, str(base))
    assert store.store_meta(spark, path)["latest_date"] == dt.date(2021, 3, 6)


def test_settings_of_an_env_file_reach_serve(spark, tmp_path, monkeypatch):
    env, path = tmp_path / "env", str(tmp_path / "s")
    env.write_text("ORIGINLAKE_BACKUP_TO=there\n# no\nORIGINLAKE_HEARTBEAT=http://127.0.0.1:9/x\n")
    for k in ("ORIGINLAKE_BACKUP_TO", "ORIGINLAKE_HEARTBEAT"):
        monkeypatch.setenv(k, "")
        monkeypatch.delenv(k)
    store.publish(stored(spark, F1), path)
    seen, done = [], threading.Event()
    monkeypatch.setattr(updater, "watch", lambda *a, **k: (seen.append(k), done.set()))
    monkeypatch.setattr(http_api, "serve", lambda *a: seen.append(a))
    assert cli.main(["--env", str(env), path, "serve", "--base", "b", "--root", "/api"], spark) == 0 and done.wait(5)
    options = next(x for x in seen if isinstance(x, dict))
    assert options["backup_to"] == "there" and callable(options["heartbeat"])
    assert next(x for x in seen if isinstance(x, tuple))[-1] == "/api"


def test_size_insert_and_replace(spark):
    h = H.build_history(obs(spark, F1))
    more = H.build_history(obs(spark, [("1.0.0.0/8", 64512, 8, dt.date(2024, 1, 2)), ("9.0.0.0/8", 9, 8)]))
    assert H.prefix_count(h) == 3 and not H.is_empty(h) and H.is_empty(h.where("false"))
    got = {r["prefix"]: [(str(x["start"]), str(x["end"])) for x in r["ranges"]] for r in H.insert_records(h, more).collect()}
    assert got["1.0.0.0/8"] == [("2024-01-01", "2024-01-02")] and len(got) == 4
    got = {r["prefix"]: [(str(x["start"]), str(x["end"])) for x in r["ranges"]] for r in H.replace_records(h, more).collect()}
    assert got["1.0.0.0/8"] == [("2024-01-02", "2024-01-02")] and len(got) == 4


def test_validation_against_every_record(spark):
    r = random.Random(3)
    day = lambda k: dt.date(1969, 11, 20) + dt.timedelta(k)
    rows = [(f"{r.choice([10, 10, 11])}.{r.randrange(3)}.{r.randrange(3)}.0/{n}", r.randrange(3), n + r.randrange(3), day(r.randrange(110))) for n in r.choices([8, 16, 23, 24], k=150)]
    h = stored(spark, rows).cache()
    asked = [(k // 2, f"{r.choice([10, 11, 12])}.{r.randrange(3)}.{r.randrange(3)}.0/{r.choice([7, 8, 16, 24, 25])}", r.choice([0, 1, 2, 3, None]), r.choice([day(r.randrange(110)), None])) for k in range(400)]
    q = with_prefix_key(spark.createDataFrame(asked, "qid int, prefix string, asn bigint, date date"))
    records = [(x["prefix"], x["root"], x["origin"], x["max_len"], [(y["start"], y["end"]) for y in x["ranges"]]) for x in h.collect()]
    net, want = lambda t: ipaddress.ip_network(t, strict=False), []
    for i, p, a, d in asked:
        roots = {x[1] for x in records if net(p).subnet_of(net(x[0]))}
        ok = d and any(x[1] in roots and x[2] == a and x[3] >= net(p).prefixlen and any(s <= d <= e for s, e in x[4]) for x in records)
        want.append((i, str(net(p)), a, d, "valid" if ok else "invalid" if roots else "unknown"))
    got = Q.validate_bulk(q, h)
    assert got.columns == [*q.columns, "result"]
    assert sorted(((x["qid"], x["prefix"], x["asn"], x["date"], x["result"]) for x in got.collect()), key=repr) == sorted(want, key=repr)
    assert {w[-1] for w in want} == {"valid", "invalid", "unknown"}
    assert not [n for n in joins(got) if "qid" in n and n & {"ranges", "_ml", "max_len"}]  # queries never meet records


def joins(df):
    """Names of the columns that come into each join of the optimized plan."""
    out, todo = [], [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        below = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Join":
            out.append({c.output().apply(i).name() for c in below for i in range(c.output().size())})
        todo += below
    return out


def test_search_by_prefix_joins_nothing(spark):
    h = stored(spark, [*F1, *V6[:2], ("1.1.0.0/16", 7, 16), ("1.2.0.0/16", 8, 16), ("9.0.0.0/8", 9, 8)]).cache()
    for asked, related, subtree in (
        ("1.1.0.0/16", {"1.0.0.0/8", "1.1.0.0/16", "1.1.1.0/24", "1.1.1.0/25"}, {"1.0.0.0/8", "1.1.0.0/16", "1.2.0.0/16", "1.1.1.0/24", "1.1.1.0/25"}),
        ("0.0.0.0/4", {"1.0.0.0/8", "1.1.0.0/16", "1.2.0.0/16", "1.1.1.0/24", "1.1.1.0/25", "9.0.0.0/8"}, set()),
        ("2001:db8:1::/48", {"2001:db8::/32", "::/0"}, {"2001:db8::/32", "::/0"}),
        ("8.8.8.0/24", set(), set()),
    ):
        for mode, want in (("related", related), ("subtree", subtree)):
            got = Q.search(h, asked, exact=False, mode=mode)
            assert {x["prefix"] for x in got.collect()} == want and got.columns == h.columns
            assert not joins(got)


def test_pairs_of_large_keys_are_dealt_over_tasks(spark):
    left = spark.createDataFrame([(k % 2, k // 3) for k in range(300)] + [(7, 1), (None, 2)], "k int, a int")
    right = spark.createDataFrame([(0, f"x{j // 2}") for j in range(90)] + [(1, "y"), (8, "z"), (None, "n")], "k int, b string")
    got = I.pairs(left, right, ["k"], pack=8)
    want = sorted((x[0], x[1], y[1]) for x in left.collect() for y in right.collect() if x[0] is not None and x[0] == y[0])
    assert sorted(tuple(x) for x in got.select("k", "a", "b").collect()) == want and len(want) == 150 * 90 + 150
    assert max(got.groupBy(F.spark_partition_id()).count().toPandas()["count"]) < len(want) / 2


def test_pairs_are_unpacked_in_small_lots(spark):
    left = spark.range(6000).select(F.lit(1).alias("k"), F.col("id").alias("a"))
    right = spark.range(1500).select(F.lit(1).alias("k"), F.col("id").alias("b"))
    lots = I.packed_pairs(left, right, ["k"]).select((F.size("_left") * F.size("_right")).alias("n")).agg(F.sum("n"), F.max("n")).first()
    assert lots[0] == 6000 * 1500 and lots[1] < 50_000  # those that one join row unpacks to are all buffered
    got = I.pairs(left, right, ["k"])
    assert got.agg(F.count(F.lit(1)), F.sum("a"), F.sum("b"), F.countDistinct((F.col("a") * 1500 + F.col("b")) % 100_003)).first()[:] == (
        6000 * 1500, sum(range(6000)) * 1500, sum(range(1500)) * 6000, 100_003
    )
