"""URL filters against brute force and SQL, on pages with links between hosts."""

import random
import re

import pytest

from pawprint.llm.queries import ORACLES, QUERIES, URL_RULES
from pawprint.llm.url_filter import judged, rule_table


def low(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def split(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (low(m[1]), m[2]) if m else ("", "")


def brute(rows, rules, cut=0.5, damping=0.85):
    """page_id, host, path, rule, verdict by plain loops."""
    pages, links = [], {}
    for page, url, html in rows:
        host, path = split(url)
        fits = [(len(h + p), h + p, a) for a, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        pages.append((page, host, path, *(max(fits)[1:] if fits else (None, None))))
        for link in re.findall(r"""(?is)<a[\t-\r ][^<>]*?href[\t-\r ]*=[\t-\r ]*("[^"]*"|'[^']*'|[^\t-\r <>"']+)""", html or "") if host else []:
            link = re.sub(r"""^["']|["']$""", "", link).lstrip("\t\n\x0b\x0c\r ")
            if re.match(r"//|[A-Za-z][A-Za-z0-9+.-]*://", link):
                to = low(re.match(r"(?s).*?//([^/?#]*)", link)[1])
            elif re.match(r"#|[A-Za-z][A-Za-z0-9+.-]*:", link):
                to = ""
            else:
                to = host
            if to:
                links[host, to] = links.get((host, to), 0) + 1
    masses = []
    for action, turned in (("allow", False), ("block", True)):
        hosts = {p[1] for p in pages} - {""}
        seed = {h: sum(p[1] == h and p[4] == action for p in pages) / sum(p[1] == h for p in pages) for h in hosts}
        edges = {(b, a) if turned else (a, b): n for (a, b), n in links.items()}
        total = {}
        for (a, _), n in edges.items():
            total[a] = total.get(a, 0) + n
        mass = dict(seed)
        for _ in range(200):
            then = {h: s * (1 - damping) for h, s in seed.items()}
            for (a, b), n in edges.items():
                then[b] = then.get(b, 0) + damping * mass.get(a, 0) * n / total[a]
            mass = then
        masses.append(mass)
    out = []
    for page, host, path, rule, action in pages:
        t, d = (m.get(host, 0) if host else 0 for m in masses)
        out.append((page, host, path, rule, action or ("block" if t + d and round(d / (t + d), 6) > cut else "allow")))
    return out


def odd_pages():
    r = random.Random(8)
    hosts = ["a.example.org", "example.org", "b.com", "x.b.com", "good.net", "bad.net", "far.net", "Mixed.NET", "org", "com"]
    rows = []
    for i in range(150):
        url = r.choice(["http://", "https://"]) + r.choice(hosts) + r.choice(["", "/", "/es/", "/en/1", "/en/2", "/fr/9", "/de/4", "?x=/fr/", "#://y.org/"])
        to = ["bad.net", "b.com"] if "bad" in url else ["good.net", "a.example.org"] if "good" in url else hosts
        link = lambda: r.choice([f'<a href="http://{r.choice(to)}/q">', f"<A  class=x HREF = 'HTTPS://{r.choice(to)}'>", "<a href=/own>", '<a href="#top">', '<a href="mailto:x@y.org">', f'<a href="//{r.choice(to)}/z">', "<a name=x>", "<abbr href=http://far.net/>"])
        rows.append((i, url, "".join(link() for _ in range(r.randint(0, 8)))))
    return [*rows, (None, None, '<a href="http://bad.net">'), (7, "no scheme", "<a href=/x>"), (7, "http:///p", None), (8, "://UP.Org/es/x", ""), (9, "http://é.example.org/es/a?b", "<a href=" * 3)]


def table(spark, rows):
    return spark.createDataFrame([(*x, 1, "k") for x in rows], "page_id bigint, url string, html string, host int, rule string")


def plain(df):
    return sorted(map(str, map(tuple, df.select("page_id", "host", "path", "rule", "verdict").collect())))


@pytest.mark.parametrize("bytes_", [None, -1])
def test_equals_brute_force(spark, monkeypatch, bytes_):
    """With broadcasts, and with shuffles in their place."""
    if bytes_:
        monkeypatch.setattr("pawprint.llm.common.BROADCAST_BYTES", bytes_)
    rows = odd_pages()
    rules = [*URL_RULES, ("block", "bad.net", "/"), ("allow", "good.net", "/")]
    want = brute(rows, rules)
    assert plain(judged(table(spark, rows), rule_table(spark, rules), most_steps=25)) == sorted(map(str, want))
    spread = {(x[1], x[4]) for x in want if x[3] is None and x[1].endswith(".net")}
    assert {v for _, v in spread} == {"allow", "block"}


def test_query_equals_sql_and_brute_force(spark, small, tmp_path):
    import duckdb

    rows = odd_pages() + [tuple(r) for r in spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url", "html").collect()]
    table(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = QUERIES["op12_url_filter"](spark, str(tmp_path))
    want = sorted(map(str, brute(rows, URL_RULES)))
    assert plain(got) == want
    assert sorted(map(str, con.execute(ORACLES["op12_url_filter"]).fetchall())) == want


def test_empty(spark):
    none = table(spark, odd_pages()).limit(0)
    assert judged(none, rule_table(spark, URL_RULES)).count() == 0
    got = judged(table(spark, odd_pages()), rule_table(spark, []))
    assert {(r.rule, r.verdict, r.trust, r.distrust) for r in got.collect()} == {(None, "allow", 0.0, 0.0)}
