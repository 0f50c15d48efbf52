import pytest
from tesserakit.operators.logparse import SCHEMA, Scanner, parse_logs, parse_text, read_entry

HEADS = {
    "2025-01-20 08:17:23,173 - maild - debug - loaded x": ("2025-01-20 08:17:23", "DEBUG", "maild", "loaded x"),
    "2025/04/24 05:48:02 shutting down x - 9 left": ("2025-04-24 05:48:02", "", "", "shutting down x - 9 left"),
    "[23/Jul/2025:17:08:13 +0530] store_pool INFO: down": ("2025-07-23 11:38:13", "INFO", "store_pool", "down"),
    "2025-01-16T09:32:05.487Z NOTICE  [maild] user": ("2025-01-16 09:32:05", "INFO", "maild", "user"),
    "Jan 16 00:16:14 host parse[5013]: debug: open": ("2024-01-16 00:16:14", "DEBUG", "parse", "open"),
    "Jul  7 05:22:14 volume54 sync_pool[4713]: ERR: cannot": ("2024-07-07 05:22:14", "ERROR", "sync_pool", "cannot"),
    "WRN|watch_pool|16.01.2025 00.18.53|harbor opened": ("2025-01-16 00:18:53", "WARN", "watch_pool", "harbor opened"),
    "1751865735.254 query-worker <CRITICAL> cannot": ("2025-07-07 05:22:15", "FATAL", "query-worker", "cannot"),
    "20250119-105414 (watch) outage opened": ("2025-01-19 10:54:14", "", "watch", "outage opened"),
    "E0430 12:23:02.634383    8232 sync.core:784] cannot": ("2024-04-30 12:23:02", "ERROR", "sync.core", "cannot"),
    '{"level": "SEVERE", "msg": "a \\"b\\"", "ts": "2025-04-30T04:24:04-08:00", "logger": "stored"}': ("2025-04-30 12:24:04", "ERROR", "stored", 'a "b"'),
    'time=2025-07-15T20:11:24+00:00 level=WARNING component=w msg="a b" pid=1': ("2025-07-15 20:11:24", "WARN", "w", "a b"),
    "2025-06-11 10:00:00 [main] ERROR com.x.Y - boom": ("2025-06-11 10:00:00", "ERROR", "main", "com.x.Y - boom"),
}


@pytest.mark.parametrize("line", HEADS)
def test_heads(line):
    assert read_entry(line, 2024) == HEADS[line]


@pytest.mark.parametrize(
    "line",
    ["", "  seen at 2025-03-04 10:11:12 by X", "2025-02-14 was the last good run", "ERROR text follows", "Traceback (most recent call last):", '{"level": "INFO"}', "{", '"', "1551 rows lost", "2025-13-41 10:00:00 x"],
)
def test_continuations(line):
    assert read_entry(line, 2024) is None


def test_entries_span_lines():
    text = "preamble\n2025/01/01 00:00:00 a\n  b\n\nc\n\n2025/01/01 00:00:01 d\r\n\n"
    assert parse_text(text, 2025) == [(2, "2025-01-01 00:00:00", "", "", "a\n  b\n\nc", 4), (7, "2025-01-01 00:00:01", "", "", "d", 1)]


def test_scanner_goes_no_further_than_asked():
    s = Scanner('a 1 "x\\"y" z')
    assert [s.token(k)[1] for k in range(5)] == ["a", " ", "1", " ", '"x\\"y"'] and len(s.tokens) == 5


def test_table_edge_cases(spark):
    rows = [
        ("a.log", "Jan  1 00:00:00 h p[1]: info: x", {"file_modified_at": "2023-05-05T00:00:00+00:00"}, 1),
        ("a.log", "Jan  1 00:00:00 h p[1]: info: x", {"file_modified_at": "2023-05-05T00:00:00+00:00"}, 2),
        ("n.log", None, None, 3),
        ("e.log", "", {}, 4),
        ("m.log", "Jan  1 00:00:00 h p[1]: info: x", None, 5),
        (None, "2025/01/01 00:00:00 " + "y" * 200_000, None, 6),
    ]
    files = spark.createDataFrame(rows, "source_path string, text string, metadata map<string,string>, stamp int")
    got = sorted(parse_logs(files).select("source_path", "entry_ts", "n_lines").collect(), key=lambda r: str(r[0]))
    assert [tuple(r) for r in got] == [(None, "2025-01-01 00:00:00", 1), ("a.log", "2023-01-01 00:00:00", 1), ("m.log", "1970-01-01 00:00:00", 1)]
    assert parse_logs(files.limit(0)).collect() == [] and parse_logs(files).schema == SCHEMA


LAYOUTS = {
    '127.0.0.1 - frank [10/Oct/2000:13:55:36 -0700] "GET /a HTTP/1.0" 200 2326': ("2000-10-10 20:55:36", "", ""),
    "[Fri Sep 09 10:42:29.902022 2011] [core:error] [pid 35708:tid 432] [client 72.15.99.187] File missing": ("2011-09-09 10:42:29", "ERROR", "core"),
    "[Wed Oct 11 14:32:52 2000] [error] [client 127.0.0.1] denied": ("2000-10-11 14:32:52", "ERROR", ""),
    "<34>1 2003-10-11T22:14:15.003Z mymachine.example.com su - ID47 - failed for x": ("2003-10-11 22:14:15", "FATAL", "su"),
    '<165>1 2003-08-24T05:14:15.000003-07:00 192.0.2.1 evntslog 8710 - [a@1 b="c"] started': ("2003-08-24 12:14:15", "INFO", "evntslog"),
    "<35>Oct 11 22:14:15 mymachine su[77]: failed": ("2024-10-11 22:14:15", "ERROR", "su"),
    "17/06/09 20:10:40 INFO executor.Executor: Running task": ("2017-06-09 20:10:40", "INFO", "executor.Executor"),
    "01/31/2024 11:02:03 PM ERROR Store.Disk: full": ("2024-01-31 23:02:03", "ERROR", "Store.Disk"),
    "31/01/2024 12:02:03 WARN disk: full": ("2024-01-31 12:02:03", "WARN", "disk"),
    "2024-03-01 10:00:00.123  INFO 1234 --- [           main] o.s.b.Application   : Started": ("2024-03-01 10:00:00", "INFO", "o.s.b.Application"),
    "2024-03-01 10:00:00,123 [pool-2-thread-7] WARN  com.foo.Bar - slow": ("2024-03-01 10:00:00", "WARN", "com.foo.Bar"),
    "10:15:30.123 [main] DEBUG com.foo.Bar - started": ("2024-05-06 10:15:30", "DEBUG", "com.foo.Bar"),
}


@pytest.mark.parametrize("line", LAYOUTS)
def test_other_layouts(line):
    assert read_entry(line, 2024, (5, 6))[:3] == LAYOUTS[line]


def test_lookahead():
    head, after = "2024-01-15 10:00:00 ERROR store: no backup", "2024-01-15 10:00:05 INFO store: up"
    late = "2024-01-14 09:00:00 was the last good backup"
    got = parse_text("\n".join([head, late, "more", after]), 2024)
    assert [(e[0], e[5]) for e in got] == [(1, 3), (4, 1)] and got[0][4] == f"no backup\n{late}\nmore"
    # in order, or one of several of its layout, it is an entry
    assert len(parse_text("\n".join([head, "2024-01-15 10:00:03 plain", after]), 2024)) == 3
    assert len(parse_text("\n".join([head, late, after, "2024-01-15 10:00:06 plain"]), 2024)) == 4
    # between indented lines a little out of order is enough
    assert [e[0] for e in parse_text("\n".join([head, "  at a", "2024-01-15 09:59:59 seen", "  at b", after]), 2024)] == [1, 5]
    # within an open bracket, up to the line that closes it
    dump = ["2024-01-15 10:00:00 INFO store: payload {", "time=2024-01-15T10:00:01Z level=debug msg=x", "}", after]
    assert [(e[0], e[5]) for e in parse_text("\n".join(dump), 2024)] == [(1, 3), (4, 1)]
    assert [e[0] for e in parse_text("\n".join([*dump[:2], after]), 2024)] == [1, 2, 3]
