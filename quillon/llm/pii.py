"""Personal data by weak supervision, in DataFrame and SQL functions only.

Patterns propose spans: four base kinds, which are always kept once their own check holds, and further kinds
which are only candidates. Labelers vote on every span for (1), against (-1) or not at all (0): the shape
of the match (regex), lists of known domains, prefixes and country codes (gazetteer), words nearby (context), and the
characters at its edges. Expectation-maximisation over the counts of vote patterns (at most 3**4) estimates how
reliable each labeler is. Its probabilities are the soft labels on which the span classifier is trained, a
log-linear model over categorical features of the span whose weights are ratios of weighted counts. A
candidate becomes a result if the classifier gives it MOST or more.

A pattern's matches are those of a left-to-right search. Their places follow from the lengths of the pieces
between them, in code points. The patterns never retry inside a run that they have passed, so time is linear
in the text.

What reaches the driver is the model: 25 probabilities, and one weight for each of a fixed set of feature
values. Defined cases: a null text is the empty text; without any span the votes' prior stays at one half.
Equal texts give equal spans; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import cut

BASE = ("email", "ip", "card", "phone")
EXTRA = ("obfuscated", "iban", "ssn", "account", "local")
ROUNDS, MOST = 25, 0.5
#: Matches of a document whose places are summed in one go.
BLOCK = 512
NEAR = 40

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: kind: (what a text must have, pattern, check of the match m). A pattern may start where the last match ended or where no run of its first class is cut.
PATTERNS = {
    "email": ("contains(text, '@')", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true"),
    "ip": ("digits", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", rf"m rlike '^{_OCTET}(?:[.]{_OCTET}){{3}}$'"),
    "card": ("digits", r"[0-9](?:[\x20-]?[0-9])++", "length(regexp_replace(m, '[^0-9]', '')) between 13 and 19 and luhn_check(regexp_replace(m, '[^0-9]', ''))"),
    "phone": ("contains(text, '+')", r"\+[0-9][\x20().0-9-]+[0-9]", "length(regexp_replace(m, '[^0-9]', '')) between 9 and 15"),
    "obfuscated": ("text rlike '[(\\\\[](?:at|AT)[)\\\\]]'", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[](?:at|AT)[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:[(\[](?:dot|DOT)[)\]]|\.)\x20?[A-Za-z0-9-]++)++", "true"),
    "iban": ("digits", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "true"),
    "ssn": ("digits", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "true"),
    "account": ("digits", r"(?<![A-Za-z0-9.@_-])[0-9]{9,19}(?![A-Za-z0-9.@_-])", "true"),
    "local": ("digits", r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])", "true"),
}
# Lists and cue words that the labelers know.
DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|uk|it|nl|eu|ch|at|us|ca"
CALLING = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|55|61|81|86|91"
IBAN_STATES = "AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE"
CUES = {
    "email": "mail|contact|write|reach|address|correo|courriel",
    "ip": "ip|host|server|address|login|from",
    "card": "card|visa|master|credit|pay|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|whatsapp",
    "obfuscated": "mail|contact|write|reach|address",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social|security",
    "account": "account|konto|compte|cuenta|passport|licen|patient|customer",
    "local": "phone|call|tel|mobile|fax",
}
AGAINST = "version|isbn|issn|doi|order|invoice|serial|build|figure|table|chapter|page"


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _before(lens: str) -> str:
    """SQL: the sum of the lengths before each item, block by block."""
    total = lambda a: f"aggregate({a}, 0, (z, x) -> z + x)"
    blocks = f"transform(sequence(0, (size({lens}) - 1) div {BLOCK}), b -> {total(f'slice({lens}, cast(b * {BLOCK} as int) + 1, {BLOCK})')})"
    within = f"transform(sequence(0, least({BLOCK}, size({lens}) - b * {BLOCK}) - 1), j -> s + {total(f'slice({lens}, cast(b * {BLOCK} as int) + 1, cast(j as int))')})"
    each = f"transform(sequence(0, size(t) - 1), b -> transform(array({total('slice(t, 1, cast(b as int))')}), s -> {within})[0])"
    return f"flatten(flatten(transform(array({blocks}), t -> {each})))"


def _spans(kind: str) -> Column:
    """Array of (kind, start, end, txt, left, right): matches that pass their check, with the text around."""
    has, pattern, check = PATTERNS[kind]
    q = _quoted(pattern)
    lens = "zip_with(ms, slice(ps, 1, size(ms)), (m, p) -> length(m) + length(p))"
    item = f"""struct('{kind}' as kind, at[i] + length(ps[i]) as start, at[i] + length(ps[i]) + length(ms[i]) as end, ms[i] as txt,
      right(ps[i], {NEAR}) as left, left(ps[i + 1], 1) as right)"""
    rows = f"transform(array({_before('ls')}), at -> transform(sequence(0, size(ms) - 1), i -> {item}))[0]"
    rows = f"transform(array({lens}), ls -> {rows})[0]"
    rows = f"transform(array(split(text, {q}, -1)), ps -> {rows})[0]"
    rows = f"transform(array(regexp_extract_all(text, {q}, 0)), ms -> if(size(ms) = 0, null, {rows}))[0]"
    checked = f"filter({rows}, c -> {check.replace('m rlike', 'c.txt rlike').replace('(m,', '(c.txt,')})"
    none = "cast(array() as array<struct<kind:string,start:int,end:int,txt:string,left:string,right:string>>)"
    return F.expr(f"coalesce(if({has}, {checked}, null), {none})")


def votes() -> str:
    """SQL: the four labelers' votes on a span c."""
    digits = "regexp_replace(c.txt, '[^0-9]', '')"
    shape = f"""case c.kind
      when 'email' then if(c.txt rlike '[.][A-Za-z]{{2,24}}$', 1, -1)
      when 'ip' then if(c.txt rlike '(^|[.])0[0-9]|^0[.]', -1, 1)
      when 'card' then if({digits} rlike '^[3-6]', 1, if({digits} rlike '^0', -1, 0))
      when 'phone' then if(length({digits}) between 10 and 13, 1, 0)
      when 'iban' then if(length(replace(c.txt, ' ', '')) between 15 and 31, 1, -1)
      when 'ssn' then if(c.txt rlike '^(000|666|9)|-00-|-0000$', -1, 1)
      when 'account' then if({digits} rlike '^([0-9])\\\\1+$', -1, 0)
      when 'local' then if({digits} rlike '^[2-9]', 1, -1)
      else 0 end"""
    known = f"""case c.kind
      when 'email' then if(lower(c.txt) rlike '[.]({DOMAINS})$', 1, 0)
      when 'obfuscated' then if(lower(c.txt) rlike '({DOMAINS})$', 1, -1)
      when 'ip' then if(c.txt rlike '^(0|127|255|22[4-9]|2[34][0-9])[.]', -1, if(c.txt rlike '^(10|192[.]168|172[.](1[6-9]|2[0-9]|3[01]))[.]', 0, 1))
      when 'card' then if({digits} rlike '^(4|5[1-5]|3[47]|6011|65|2[2-7])', 1, 0)
      when 'phone' then if(c.txt rlike '^[+]({CALLING})', 1, -1)
      when 'iban' then if(c.txt rlike '^({IBAN_STATES})', 1, -1)
      else 0 end"""
    cues = " ".join(f"when '{k}' then {_quoted(f'(^|[^a-z])({v})')}" for k, v in CUES.items())
    near = f"case when lower(c.left) rlike (case c.kind {cues} end) then 1 when lower(c.left) rlike '(^|[^a-z])({AGAINST})' then -1 else 0 end"
    edges = "if(c.left rlike '[A-Za-z0-9_/=]$' or c.right rlike '[A-Za-z0-9_/=]', -1, 1)"
    return f"array({shape}, {known}, {near}, {edges})"


def features() -> str:
    """SQL: categorical features of a span c as strings; their values form a fixed set."""
    return f"""array(concat('kind=', c.kind), concat('len=', c.kind, '/', least(length(c.txt) div 4, 10)),
      concat('left=', case when c.left = '' then 'start' when c.left rlike '\\\\s$' then 'space' when c.left rlike '[A-Za-z0-9]$' then 'word' else 'mark' end),
      concat('right=', case when c.right = '' then 'end' when c.right rlike '\\\\s' then 'space' when c.right rlike '[A-Za-z0-9]' then 'word' else 'mark' end),
      concat('votes=', array_join(transform({votes()}, v -> cast(v as string)), '/')))"""


def estimate(patterns: DataFrame) -> DataFrame:
    """One row (pi, a, b) from vote patterns (v, n): the share of real spans, and each labeler's chances of the
    votes -1, 0, 1 on real and on other spans (three for each labeler), after ROUNDS of EM."""
    one = patterns.agg(F.collect_list(F.struct(F.col("n").cast("double").alias("n"), "v")).alias("pats"))
    q = "1 / (1 + exp(ln((1 - s.pi) / s.pi) + aggregate(sequence(0, 3), 0D, (z, l) -> z + ln(s.b[3 * l + p.v[l] + 1] / s.a[3 * l + p.v[l] + 1]))))"
    posts = f"transform(pats, p -> struct(p.n as n, p.v as v, {q} as q))"
    total = lambda x: f"aggregate(ps, 0D, (z, p) -> z + {x})"
    chances = lambda x: f"transform(sequence(0, 11), j -> ({total(f'if(p.v[cast(j div 3 as int)] = j % 3 - 1, {x}, 0D)')} + 1) / ({total(x)} + 3))"
    step = f"transform(array({posts}), ps -> struct(({total('p.n * p.q')} + 1) / ({total('p.n')} + 2) as pi, {chances('p.n * p.q')} as a, {chances('p.n * (1 - p.q)')} as b))[0]"
    start = "struct(0.5D as pi, array_repeat_a as a, array_repeat_b as b)".replace("array_repeat_a", "array(" + ", ".join(["0.1D, 0.2D, 0.7D"] * 4) + ")").replace("array_repeat_b", "array(" + ", ".join(["0.5D, 0.3D, 0.2D"] * 4) + ")")
    return one.select(F.expr(f"aggregate(sequence(1, {ROUNDS}), {start}, (s, i) -> {step})").alias("s")).select("s.*")


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, extra): arrays of (kind, start, end, p); extra ones are those that the classifier accepts."""
    common.prepare(docs.sparkSession)
    rows = common.text_of(docs).withColumn("digits", F.col("text").rlike("[0-9]"))
    rows = rows.select("doc_id", F.concat(*map(_spans, BASE)).alias("base"), F.concat(*map(_spans, EXTRA)).alias("more"))
    rows = rows.withColumn("more", F.expr("if(size(more) = 0, more, filter(more, x -> not exists(base, c -> c.start < x.end and x.start < c.end)))"))
    judged = f"transform(@, c -> struct(c.kind, c.start, c.end, {votes()} as v, {features()} as f))"
    rows = cut(rows.select("doc_id", F.expr(judged.replace("@", "base")).alias("base"), F.expr(judged.replace("@", "more")).alias("more")))
    each = rows.filter("size(base) + size(more) > 0").select(F.explode(F.concat("base", "more")).alias("c"))
    em = estimate(each.groupBy(F.col("c.v").alias("v")).agg(F.count("*").alias("n"))).first()
    numbers = lambda xs: F.lit([float(x) for x in xs])
    odds = F.lit(float(em["pi"])), numbers(em["a"]), numbers(em["b"])
    soft = each.select("c.f", odds[0].alias("pi"), odds[1].alias("a"), odds[2].alias("b"), F.col("c.v").alias("v"))
    soft = soft.withColumn("q", F.expr("1 / (1 + exp(ln((1 - pi) / pi) + aggregate(sequence(0, 3), 0D, (z, l) -> z + ln(b[3 * l + v[l] + 1] / a[3 * l + v[l] + 1]))))"))
    counts = soft.select(F.explode("f").alias("f"), "q").groupBy("f").agg(F.sum("q").alias("real"), F.sum(1 - F.col("q")).alias("other")).collect()
    kinds = [r for r in counts if r["f"].startswith("kind=")]
    real, other = sum(r["real"] for r in kinds) + 2, sum(r["other"] for r in kinds) + 2
    weights = {r["f"]: math.log((r["real"] + 0.5) / real) - math.log((r["other"] + 0.5) / other) for r in sorted(counts, key=lambda r: r["f"])}
    table = F.map_from_arrays(F.lit(list(weights)), F.lit(list(weights.values()))) if weights else F.create_map().cast("map<string,double>")
    prior = F.lit(math.log(real / other))
    score = lambda c: 1 / (1 + F.exp(-F.aggregate(c["f"], prior, lambda z, f: z + F.coalesce(table[f], F.lit(0.0)))))
    with_p = lambda a: F.transform(a, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), score(c).alias("p")))
    extra = F.filter(with_p("more"), lambda c: c["p"] >= MOST)
    return rows.select("doc_id", with_p("base").alias("base"), extra.alias("extra"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans(common.documents(spark, sf_dir))
    text = lambda a: F.concat_ws(",", F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *map(count, BASE), F.sha2(text("base"), 256).alias("base_sha256"), text(F.concat("base", "extra")).alias("spans"))
