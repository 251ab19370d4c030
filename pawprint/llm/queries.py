"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from .common import documents

QUERIES = {}
ORACLES = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@_query(
    "op3_exact_dedup",
    """
    with d as (select doc_id, coalesce(text, '') as t from documents),
    g as (select doc_id, t, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size from d)
    select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from g
    """,
)
def op3_exact_dedup(spark, sf_dir):
    from .exact_dedup import exact_groups

    return exact_groups(documents(spark, sf_dir), keep="largest")


@_query("op9_token_counts")
def op9_token_counts(spark, sf_dir):
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


@_query("op10_token_tables")
def op10_token_tables(spark, sf_dir):
    import public_tokenizers

    from .token_tables import token_tables

    return token_tables(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


@_query("op1_byte_bpe")
def op1_byte_bpe(spark, sf_dir):
    import public_tokenizers

    from .bpe import digests, encode_documents

    return digests(encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


@_query("op4_warc")
def op4_warc(spark, sf_dir):
    from .warc import archive_round_trip

    read = archive_round_trip(documents(spark, sf_dir, "pages"), revisit_bytes=0)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query(
    "op8_decontaminate",
    r"""
    with item_words as (
      select coalesce(cast(item_id as varchar), '') as item_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
      from benchmark),
    windows as (
      select distinct item_id, w[i : i + 9] as words, len(w[i : i + 9]) as size
      from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from item_words where len(w) > 0)),
    d as (
      select doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
      from documents),
    grams as (
      select doc_id, i, size, w[i : i + size - 1] as words
      from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from d, (select distinct size from windows) s where len(w) >= size)),
    m as (select doc_id, i, size, item_id from grams join windows using (words, size)),
    h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + size)) as p from m) group by doc_id),
    t as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as items from m group by doc_id)
    select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
      sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from d left join h using (doc_id) left join t using (doc_id)
    """,
)
def op8_decontaminate(spark, sf_dir):
    from .decontaminate import contamination

    return contamination(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"), n=10)


@_query("op2_quality")
def op2_quality(spark, sf_dir):
    from .quality import quality_scores

    return quality_scores(documents(spark, sf_dir), documents(spark, sf_dir, "labels"), cut=0.3, folds=5, held=0)


@_query("op7_toxicity")
def op7_toxicity(spark, sf_dir):
    from .toxicity import toxicity_scores

    return toxicity_scores(documents(spark, sf_dir), documents(spark, sf_dir, "labels"), cut=0.7, folds=3, held=1)


@_query("op5_near_dedup")
def op5_near_dedup(spark, sf_dir):
    from .near_dedup import near_groups

    return near_groups(documents(spark, sf_dir), percent=85)


@_query("op6_line_dedup")
def op6_line_dedup(spark, sf_dir):
    from pyspark.sql import functions as F

    from .line_dedup import dedup_lines

    return dedup_lines(documents(spark, sf_dir), short_partners=True).select("doc_id", "n_lines", "n_equal", "n_near", F.sha2("text", 256).alias("text_sha256"))


#: crc32 of a column's ASCII characters, bit by bit
CRC32_SQL = "xor(list_reduce(flatten([[(ascii(ch) >> bit) & 1 for bit in range(8)] for ch in string_split({}, '')]), lambda c, b: xor(c >> 1, case when xor(c & 1, b) = 1 then 3988292384 else 0 end), 4294967295::bigint), 4294967295)"
RUNS_SQL = rf"""
    with cut as (select row_number() over () as row, doc_id, {CRC32_SQL.format("cast(doc_id as varchar)")} as h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
    g as (select *, len(w) as n, (h // 10) % greatest(len(w), 1) as a, h // 10 as g from cut),
    d as (select row, doc_id, n, case when h % 10 = 0 and n > 0 then [w[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end] for i in range(n)] else w end as w from g),
    t as (select row, n, unnest(range(len(w) - 2)) as i, unnest([hash(w[k], w[k + 1], w[k + 2]) for k in range(1, len(w) - 1)]) as t from d where n >= 6),
    pairs as (select x.row, x.n, x.i, y.i - x.i as p from t x join t y on x.row = y.row and x.t = y.t and y.i > x.i and (y.i - x.i) * 4 <= x.n),
    islands as (select *, i - row_number() over (partition by row, p order by i) as island from pairs),
    stretches as (select row, p, min(i) as start, count(*) + 2 + p as length from islands group by row, p, island having count(*) + 2 + p >= greatest(6, 4 * p)),
    runs as (select row, start, length, min(p) as period from stretches group by row, start, length),
    listed as (select row, count(*) as n_runs, min({{'l': -length, 's': start, 'p': period}}) as best, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines from runs group by row),
    gone as (select row, list(distinct i) as gone from (select row, unnest(range(start + period, start + length)) as i from runs) group by row)
    select d.doc_id, coalesce(n_runs, 0) as n_runs, best.s as start, -best.l as length, best.p as period, -1000 * best.l // best.p as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256,
      sha256(array_to_string(case when gone is null then w else list_filter(w, lambda x, k: not list_contains(gone, k - 1)) end, ' ')) as collapsed_sha256
    from d left join listed using (row) left join gone using (row)
    """


@_query("op11_runs", RUNS_SQL)
def op11_runs(spark, sf_dir):
    from .runs import digests, periodic_runs, planted

    return digests(periodic_runs(planted(documents(spark, sf_dir))))


REPAIR_SQL = rf"""
    with recursive named as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as name from conversations),
    how as (select *, {CRC32_SQL.format("name")} % 20 as how from named),
    damaged as (select conv_id, turn, case when how = 4 then 'user' else role end as role, case how when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
      from how, (values (1), (2)) copies(c) where how <> 0 and (c = 1 or how = 3)),
    placed as (select *, row_number() over (partition by conv_id, role, text order by i) as again, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) as last
      from (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from damaged)),
    faulty as (select *, last = '' as blank, last <> '' and again > 1 as duplicate, last <> '' and again = 1 and last not in ('.', '!', '?') as truncated, left(role, 1) as letter,
      lag(left(role, 1)) over (partition by conv_id order by i) || left(role, 1) as pair from placed),
    counted as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (duplicate) as duplicate,
      count(*) filter (truncated) as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal from faulty group by conv_id),
    ways(a, b, price, edit, what) as (values ('-', 's', 0, 'K', 's'), ('-', 'u', 0, 'K', 'u'), ('s', 'u', 0, 'K', 'u'), ('u', 'a', 0, 'K', 'a'), ('a', 'u', 0, 'K', 'u'),
      ('-', 'u', 3, 'R', ''), ('s', 'u', 3, 'R', ''), ('u', 'a', 3, 'R', ''), ('a', 'u', 3, 'R', ''), ('-', '-', 4, 'D', ''), ('s', 's', 4, 'D', ''), ('u', 'u', 4, 'D', ''), ('a', 'a', 4, 'D', '')),
    inserts(a, b, n) as (values ('-', '-', 0), ('-', 'u', 1), ('-', 'a', 2), ('s', 's', 0), ('s', 'u', 1), ('s', 'a', 2), ('u', 'u', 0), ('u', 'a', 1), ('a', 'a', 0), ('a', 'u', 1)),
    moves as (select x.a, y.b, x.n * 3 + w.price + y.n * 3 as price, repeat('I', x.n) || w.edit || repeat('I', y.n) as edits, w.edit, w.what from inserts x join ways w on x.b = w.a join inserts y on w.b = y.a),
    steps as (select conv_id, i, m.a, m.b, min({{'cost': m.price + case when truncated and m.edit <> 'D' then 3 else 0 end, 'edits': m.edits}}) as way from faulty join moves m on (m.edit = 'D' or not blank and not duplicate) and (m.edit <> 'K' or m.what = letter) group by all),
    best(conv_id, i, b, way) as (
      select conv_id, 0::bigint, '-', {{'cost': 0::bigint, 'audit': ''}} from (select distinct conv_id from conversations)
      union all
      select s.conv_id, any_value(s.i), s.b, min({{'cost': (best.way.cost + s.way.cost)::bigint, 'audit': best.way.audit || s.way.edits}})
      from best join steps s on s.conv_id is not distinct from best.conv_id and s.i = best.i + 1 and s.a = best.b group by s.conv_id, s.b),
    solved as (select best.conv_id, min(way) as way from best left join counted c on c.conv_id is not distinct from best.conv_id where best.i = coalesce(c.n, 0) and b in ('-', 'a') group by best.conv_id),
    edits as (select conv_id, pos, substring(way.audit, pos, 1) as edit from (select *, unnest(range(1, length(way.audit) + 1)) as pos from solved)),
    dealt as (select *, count(*) filter (edit <> 'I') over (partition by conv_id order by pos) as i from edits),
    stays as (select d.conv_id, d.pos, d.edit, case when d.edit <> 'I' then f.text else '' end as text, case when d.edit = 'K' then f.role end as role,
      row_number() over (partition by d.conv_id order by d.pos) as k from dealt d left join faulty f on f.conv_id is not distinct from d.conv_id and f.i = d.i where d.edit <> 'D'),
    led as (select *, first_value(coalesce(left(role, 1), 'u')) over (partition by conv_id order by pos) = 's' as led from stays),
    lines as (select conv_id, string_agg(coalesce(role, case when (k % 2 = 1) <> led then 'user' else 'assistant' end) || ':' || text, chr(10) order by pos) as lines from led group by conv_id)
    select s.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
      s.way.cost as cost, s.way.audit as audit, sha256(coalesce(l.lines, '')) as repaired_sha256
    from solved s left join counted c on c.conv_id is not distinct from s.conv_id left join lines l on l.conv_id is not distinct from s.conv_id
    """


@_query("op13_conversations", REPAIR_SQL)
def op13_conversations(spark, sf_dir):
    from .conversations import damaged, digests, repair

    return digests(repair(damaged(documents(spark, sf_dir, "conversations"))))


#: Action, host and path of each rule.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
URL_SQL = rf"""
    with recursive rules(action, rule_host, rule_path) as (values {", ".join(map(str, URL_RULES))}),
    p as (select row_number() over () as row, page_id, {_LOWER.format(r"coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} as host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path, html from pages),
    fits as (select row, arg_max({{'rule': rule_host || rule_path, 'action': action}}, length(rule_host || rule_path)) as best from p join rules on (host = rule_host or host like '%.' || rule_host) and starts_with(path, rule_path) group by row),
    r as (select p.*, best.rule as rule, best.action as action from p left join fits using (row)),
    raw as (select host, regexp_replace(regexp_replace(unnest(regexp_extract_all(html, '(?is)<a[\x09-\x0D\x20][^<>]*?href[\x09-\x0D\x20]*=[\x09-\x0D\x20]*("[^"]*"|''[^'']*''|[^\x09-\x0D\x20<>"'']+)', 1)), '^["'']|["'']$', '', 'g'), '^[\x09-\x0D\x20]+', '') as link from p where host <> ''),
    led as (select host as src, case when starts_with(link, '//') or regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') then nullif({_LOWER.format("regexp_extract(link, '(?s)^.*?//([^/?#]*)', 1)")}, '')
      when starts_with(link, '#') or regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') then null else host end as dst from raw),
    links as (select src, dst, count(*) as n from led where dst is not null group by src, dst),
    shares as (select host, count(*) filter (action = 'allow') / count(*)::double as trust, count(*) filter (action = 'block') / count(*)::double as distrust from r where host <> '' group by host),
    -- a giver '' of mass 1 that keeps its mass stands for what each step adds to the seeds
    edges as materialized (select 'trust' as kind, src as giver, dst as host, n / sum(n) over (partition by src)::double * 0.85 as share from links union all select 'distrust', dst, src, n / sum(n) over (partition by dst)::double * 0.85 from links
      union all select 'trust', '', host, trust * 0.15 from shares union all select 'distrust', '', host, distrust * 0.15 from shares union all select k, '', '', 1.0 from (values ('trust'), ('distrust')) v(k)),
    masses(step, kind, host, mass) as (
      select 0, k, '', 1.0::double from (values ('trust'), ('distrust')) v(k) union all select 0, 'trust', host, trust from shares union all select 0, 'distrust', host, distrust from shares
      union all select any_value(m.step) + 1, m.kind, e.host, sum(m.mass * e.share)::double from masses m join edges e on m.kind = e.kind and m.host = e.giver where m.step < 50 group by m.kind, e.host),
    hosts as (select host, sum(mass) filter (kind = 'trust') as t, sum(mass) filter (kind = 'distrust') as d from masses where step = 50 group by host)
    select page_id, r.host, path, rule, coalesce(action, case when round(d / nullif(t + d, 0), 6) > 0.5 then 'block' else 'allow' end) as verdict from r left join hosts on hosts.host = r.host and r.host <> ''
    """


@_query("op12_url_filter", URL_SQL)
def op12_url_filter(spark, sf_dir):
    from .url_filter import judged, rule_table

    return judged(documents(spark, sf_dir, "pages"), rule_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")
