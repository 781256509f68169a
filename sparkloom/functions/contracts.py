"""Contract text: terms, burden, parties, governing law, clause rules and edits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..shared import spread
from .text import STATE_CODES, let, lookup

#: Fixed values of the checklist: preferred states and words that burden.
PREFERRED = ("illinois", "new york", "delaware")
MARKERS = ("best efforts", "shall immediately", "all employees", "any employee", "all affiliates", "portfolio companies", "perpetual", "in perpetuity", "exclusive jurisdiction")


#: What the ends of a text are cleared of.
_BLANK = " \t\n\x0b\f\r"


def _swap(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def normal(c: Column) -> Column:
    """No carriage returns, runs of blanks and tabs as one blank, ends trimmed. Texts without such runs skip the pattern."""
    runs = let(_swap(c, "\r", ""), lambda s: F.when(s.contains("\t") | s.contains("  "), F.regexp_replace(s, r"[ \t]+", " ")).otherwise(s))
    return F.btrim(_swap(runs, "\u00a0", " "), F.lit(_BLANK))


def low(c: Column) -> Column:
    s = normal(F.lower(c))
    for old, new in (("\u201c", '"'), ("\u201d", '"'), ("\u2019", "'")):
        s = _swap(s, old, new)
    return s


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(normal(c), r"\n{2,}"), lambda p: F.btrim(p, F.lit(_BLANK))), lambda p: p != "")


def has(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def _months(t: Column) -> Column:
    found = F.regexp_extract(t, r"\d+\s*(?:months|month|mo\.?|years|year|yr\.?)", 0)
    n = F.regexp_extract(found, r"^\d+", 0).try_cast("int")
    return F.when(has(t, ("mo", "year", "yr")), n * F.when(found.contains("y"), 12).otherwise(1))


def term_months(c: Column) -> Column:
    """Months of the first 'N months' or 'N years'; none: null."""
    return let(low(c), _months)


#: What carves information out, and what a clause about law speaks of.
_CARVED = ("publicly available", "independently developed", "nonconfidential basis")
_LAW = ("governing law", "jurisdiction", "venue")


def burden_score(c: Column) -> Column:
    def score(t: Column) -> Column:
        out = let(_months(t), lambda months: F.when(months > 24, F.least(F.lit(40), months - 24)).otherwise(0))
        for m in MARKERS:
            out = out + F.when(t.contains(m), 10).otherwise(0)
        out = out + F.when(t.contains("confidential information") & ~has(t, _CARVED), 25).otherwise(0)
        out = out + F.when(has(t, _LAW) & ~has(t, PREFERRED), 20).otherwise(0)
        return F.greatest(F.lit(0), F.least(out, F.lit(100)))

    return let(low(c), score)


_STATES = {code.lower(): name.title() for name, code in STATE_CODES.items()} | {name: name.title() for name in STATE_CODES}


def full_state(c: Column) -> Column:
    return lookup(_STATES, F.lower(c))


#: Patterns of parties, laws, seats and courts.
_BETWEEN = r"(?i)between\s+([^,]+?),\s+a\s+[^,]+?,\s+and\s+([^,]+?),\s+a\s+[^,]+?\s"
_CAPITALS = r"(\b[A-Z][A-Z&\-\s]{2,}\b)"
_LAWS_OF = r"(?i)laws?\s+of\s+(?:the\s+state\s+of\s+)?([A-Z][a-zA-Z]+)\b"
_SEAT = r"(?i)\b(?:a|an)\s+(?:\w+\s+){0,3}(?:corporation|company|limited|llc|inc\.)\s+(?:organized|incorporated)\s+in\s+([A-Z][a-zA-Z]+)\b"
_GOVERNING = r"(?is)govern(?:ed|ing)\s+law.*?(?:laws?\s+of\s+)?(?:the\s+state\s+of\s+)?([A-Z][a-zA-Z]+)"
_SHALL_GOVERN = r"(?is)laws?\s+of\s+(?:the\s+state\s+of\s+)?([A-Z][a-zA-Z]+)\s+shall\s+govern"
_COURTS = r"(?i)(?:exclusive\s+jurisdiction|venue)\s+(?:in|for)\s+([^,]+),\s+([A-Z][a-zA-Z]+)"


def contract_context(c: Column, head: int | None = 1200) -> Column:
    """struct<parties, party_states, governing_law, venue_city, venue_state>.

    Without a 'between' clause, parties are names in capitals among the first `head` characters (None: all). Each pattern
    runs only on texts that hold the words without which it can't match.
    """
    clean = lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, "[\"\u201c\u201d\u2019']", "")), r"\s+", " ")

    def found(s: Column) -> Column:
        text, t = s["text"], s["low"]
        every = lambda guard, pattern: F.when(guard, F.regexp_extract_all(text, F.lit(pattern))).otherwise(F.array().cast("array<string>"))
        pair = F.array(clean(F.regexp_extract(text, _BETWEEN, 1)), clean(F.regexp_extract(text, _BETWEEN, 2)))
        caps = F.filter(F.transform(F.regexp_extract_all(text if head is None else F.substring(text, 1, head), F.lit(_CAPITALS)), clean), lambda n: F.length(n) <= 80)
        parties = F.slice(F.filter(F.array_distinct(F.when(t.contains("between") & text.rlike(_BETWEEN), pair).otherwise(caps)), lambda n: n != ""), 1, 4)
        laws = every(t.contains("law"), _LAWS_OF)
        seats = every(has(t, ("organized", "incorporated")) & has(t, ("corporation", "company", "limited", "llc", "inc.")), _SEAT)
        states = F.array_distinct(F.array_compact(F.transform(F.concat(laws, seats), full_state)))
        govern = t.contains("law") & t.contains("govern")
        law = F.try_element_at(F.array_compact(F.transform(F.concat(every(govern, _GOVERNING), every(govern, _SHALL_GOVERN)), full_state)), F.lit(1))
        courts = has(t, ("jurisdiction", "venue"))
        where = full_state(F.nullif(F.when(courts, F.regexp_extract(text, _COURTS, 2)), F.lit("")))
        city = F.when(where.isNotNull(), F.trim(F.regexp_extract(text, _COURTS, 1)))
        return F.struct(parties.alias("parties"), states.alias("party_states"), law.alias("governing_law"), city.alias("venue_city"), where.alias("venue_state"))

    text = F.concat(F.lit(" "), F.coalesce(c, F.lit("")), F.lit(" "))
    return let(F.struct(text.alias("text"), F.lower(text).alias("low")), found)


#: Wording of the checklist's insertions.
HIRING = "\n\nNothing herein shall prevent you from hiring such person(s) who (i) initiate discussions without direct solicitation, (ii) had prior discussions, (iii) respond to public advertisements, or (iv) were terminated by the Company before discussions."
TERM = "The term of this Agreement shall be twenty-four (24) months."
COPIES = "\n\nHowever, you may retain copies of the materials as necessary for legal, regulatory and archival purposes."
AFFILIATES = "\n\nNotwithstanding anything herein, none of your affiliates (including any investment fund managed by you or your affiliate or any portfolio company of such fund) shall be deemed your Representatives unless they actually receive Evaluation Material, and mere board service does not create obligations."
WHO = "\n\nRepresentatives include directors, officers, advisors, employees, financing sources, consultants, accountants and attorneys. No requirement for Representatives to sign this Agreement."
COMPETE = "\n\nNotwithstanding anything herein, receipt and possession of Evaluation Material shall not restrict ordinary-course competition, including quotes or bids in direct competition, provided strict compliance with this Agreement."
CARVE = "\n\nFor clarity, Confidential Information excludes information that (i) was publicly available prior to disclosure, (ii) was known to us without obligation, (iii) was independently developed by us, or (iv) becomes available on a nonconfidential basis from a source not bound by confidentiality."


#: Words without one of which no clause rule fires.
TRIGGERS = (
    "solicit", "term", "this agreement shall remain", "return", "best efforts", "shall", "immediate", "affiliate", "governing law", "jurisdiction", "venue", "representative", "competitor", "competition", "bid", "quote", "confidential",
)
#: Patterns of the clause rules' conditions and rewrites.
_ABOUT_TERM, _KNOWN, _RETURN, _CONFIDENTIAL = r"term\b|this agreement shall remain", "known to us prior|known.*prior", "return.*(documents|materials)", r"confidential( information)?\b"
_LENGTH, _LAW_OF, _COURT_OF = r"(?is)^(.*?)(?<!\d)\d+\s*(?:years?|yr\.?|months?)", r"(?is)^(.*?)(governed by|laws? of)\s+[^.,;]+", r"(?is)^(.*?)(venue|jurisdiction)\s+[^.,;]+"
_WHO = ("directors", "officers", "advisors", "employees", "financing sources", "consultants", "accountants", "attorneys")


def suggestions(p: Column) -> Column:
    """array<struct<clause_type, operation, target, replacement>>: what the clause rules propose for one paragraph, in rule order.

    The paragraph's lower-case form and term are computed once; rewrites are built for rules that fire.
    """
    none = F.array().cast("array<struct<clause_type: string, operation: string, target: string, replacement: string>>")
    return let(low(p), lambda t: F.when(has(t, TRIGGERS), let(_months(t), lambda months: _fired(p, t, months))).otherwise(none))


def _fired(p: Column, t: Column, months: Column) -> Column:
    first = lambda pattern, to: F.regexp_replace(p, pattern, to)
    calmer = F.regexp_replace(F.regexp_replace(F.regexp_replace(p, "(?i)best efforts", "commercially reasonable efforts"), r"(?i)\bshall\b", "will"), r"(?i)\bimmediate(ly)?\b", "prompt")
    plus = lambda text: F.concat(p, F.lit(text))

    def made(when: Column, clause: str, operation: str, replacement: Column, target: Column = p) -> Column:
        return F.when(when, F.struct(F.lit(clause).alias("clause_type"), F.lit(operation).alias("operation"), target.alias("target"), replacement.alias("replacement")))

    def calm(when: Column, clause: str) -> Column:
        return F.when(when, let(calmer, lambda c: made(c != p, clause, "replace", c)))

    solicit, about_term = has(t, ("non-solicit", "nonsolicit")), t.contains("this agreement shall remain") | t.contains("term") & t.rlike(_ABOUT_TERM)
    carved = t.contains("publicly available") & t.rlike(_KNOWN) & t.contains("independently developed") & t.contains("nonconfidential basis")
    confidential, hard = t.contains("confidential") & t.rlike(_CONFIDENTIAL), has(t, ("best efforts", "shall", "immediate"))
    # only the first match of these three changes: what stands before it is kept by a reluctant group
    cut = F.replace(F.regexp_replace(p, _LENGTH, "$1@@"), F.lit("@@"), F.lit("24 months"))
    moved = F.regexp_replace(F.regexp_replace(p, _LAW_OF, "$1$2 Illinois"), _COURT_OF, "$1$2 Illinois")
    return F.array_compact(F.array(
        made(solicit & has(t, ("customer", "supplier")), "Customer/Supplier Non-Solicit", "delete", F.lit("")),
        made(solicit & has(t, ("employee", "personnel", "staff")), "Employee Non-Solicit", "replace", F.concat(first("(?i)all employees|any employee", "key executives"), F.lit(HIRING))),
        made(about_term & (F.coalesce(months, F.lit(0)) == 0), "Term", "insert", F.lit(TERM), F.lit("")),
        made(about_term & (months > 24), "Term", "replace", cut),
        made(t.contains("return") & ~t.contains("destroy") & t.rlike(_RETURN), "Return or Destroy Documents", "replace", F.concat(first("(?i)return", "return or destroy"), F.lit(COPIES))),
        calm(hard, "Legal modifiers"),
        made(t.contains("affiliate"), "Affiliate Language", "replace", plus(AFFILIATES)),
        made(has(t, _LAW) & ~has(t, PREFERRED), "State of Jurisdiction", "replace", moved),
        made(t.contains("representative") & ~has(t, _WHO), "Representative Language", "replace", plus(WHO)),
        made(has(t, ("competitor", "competition", "bid", "quote")) & ~t.rlike("will not.*prevent|restrict.*ordinary course"), "Competition Disclaimer", "replace", plus(COMPETE)),
        calm(confidential & carved & hard, "Confidential Information Carve-Out"),
        made(confidential & ~carved, "Confidential Information Carve-Out", "replace", plus(CARVE)),
    ))


def contract_review(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, para_idx, pos, clause_type, operation, target, replacement, severity): all suggestions for all paragraphs."""
    paras = spread(docs.select(id_col, text_col)).select(F.col(id_col).alias("doc_id"), F.posexplode(paragraphs(F.col(text_col))).alias("para_idx", "p"))
    found = paras.select("doc_id", "para_idx", "p", F.posexplode(suggestions(F.col("p"))).alias("pos", "s"))  # most paragraphs have none
    return found.select("doc_id", "para_idx", "pos", "s.clause_type", "s.operation", "s.target", "s.replacement", burden_score(F.col("p")).alias("severity"))


def checklist_coverage(found: DataFrame) -> DataFrame:
    """(doc_id, carve_out_ok, term_ok, affiliate_ok) of contract_review() rows."""
    kind, s = F.col("clause_type"), F.col("severity")
    return found.groupBy("doc_id").agg(
        F.bool_and((kind != "Confidential Information Carve-Out") | (s < 60)).alias("carve_out_ok"), F.bool_and((kind != "Term") | (s <= 60)).alias("term_ok"), F.bool_and((kind != "Affiliate Language") | (s < 70)).alias("affiliate_ok")
    )


#: Sections and the words that show them; and what counts as an issue of a text, with its clause and severity.
SECTIONS = (
    ("Confidentiality", r"(?i)\b(confidential|proprietary|non-disclosure)\b"),
    ("Term", r"(?i)\b(term|duration|period|expires?|years?)\b"),
    ("Governing Law", r"(?i)\b(governing law|jurisdiction|venue|courts?)\b"),
    ("Indemnification", r"(?i)\b(indemnif|hold harmless|defend)\b"),
    ("Limitation of Liability", r"(?i)\b(limitation|liability|damages|consequential)\b"),
)
ISSUES = (("fb-best-efforts", "Obligations", 60, r"(?i)best\s+efforts"), ("fb-term-perpetual", "Term", 80, r"(?i)perpetual|indefinite"))


def section_coverage(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, sections map<string, boolean>, issues array<struct<id, clause_type, severity, context>>) of whole texts.

    The second form of the checklist: which sections a text has, and 100 less 10 for each issue found. An issue's context
    is 40 characters on either side of where its first match begins. Null texts are empty.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), t.alias("t"), *[F.regexp_instr(t, F.lit(p)).alias(f"_at{i}") for i, (*_, p) in enumerate(ISSUES)])
    around = lambda at: F.btrim(F.substr("t", F.greatest(at - 40, F.lit(1)), F.least(at - 1, F.lit(40)) + 40), F.lit(_BLANK))
    issues = [F.when(F.col(f"_at{i}") > 0, F.struct(F.lit(n).alias("id"), F.lit(k).alias("clause_type"), F.lit(v).alias("severity"), around(F.col(f"_at{i}")).alias("context"))) for i, (n, k, v, _) in enumerate(ISSUES)]
    found = rows.withColumn("issues", F.array_compact(F.array(*issues)))
    return found.select("doc_id", F.greatest(F.lit(0), 100 - 10 * F.size("issues")).alias("score"), F.create_map(*[x for n, p in SECTIONS for x in (F.lit(n), F.col("t").rlike(p))]).alias("sections"), "issues")


def replace_first(c: Column, target: Column, replacement: Column) -> Column:
    at = F.position(target, c)
    return F.when((target != "") & (at > 0), F.concat(F.left(c, at - 1), replacement, F.substr(c, at + F.length(target)))).when(target == "", F.concat(replacement, c)).otherwise(c)


def apply_suggestions(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): the chosen suggestions (contract_review() rows) folded into their paragraphs in order, paragraphs rejoined."""
    paras = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(paragraphs(F.col(text_col))).alias("para_idx", "p"))
    edits = chosen.groupBy("doc_id", "para_idx").agg(F.sort_array(F.collect_list(F.struct("pos", "operation", "target", "replacement"))).alias("edits"))

    def edit(text: Column, e: Column) -> Column:
        put = F.when(e["replacement"] == "", text).otherwise(F.concat(normal(e["replacement"]), F.when(text == "", "").otherwise(F.concat(F.lit("\n"), text))))
        gone = F.when(e["target"] == "", text).otherwise(replace_first(text, e["target"], F.lit("")))
        return F.when(e["operation"] == "delete", gone).when(e["operation"] == "insert", put).otherwise(replace_first(text, e["target"], e["replacement"]))

    done = paras.join(edits, ["doc_id", "para_idx"], "left").withColumn("p", F.when(F.col("edits").isNull(), F.col("p")).otherwise(normal(F.aggregate(F.col("edits"), F.col("p"), edit))))
    joined = done.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("para_idx", "p"))).alias("ps"))
    return joined.select("doc_id", F.array_join(F.transform("ps", lambda x: x["p"]), "\n\n").alias("text"))


def risk_rollup(results: DataFrame) -> DataFrame:
    """(doc_id, score, blockers, warns, risk) of rule results (doc_id, status, level, severity)."""
    fail = F.col("status") == "fail"
    out = results.groupBy("doc_id").agg(F.sum(F.when(fail, F.col("severity")).otherwise(0)).alias("score"), F.count_if(fail & (F.col("level") == "BLOCKER")).alias("blockers"), F.count_if(fail & (F.col("level") == "WARN")).alias("warns"))
    risk = F.when((F.col("score") >= 20) | (F.col("blockers") >= 1), "HIGH").when((F.col("score") >= 10) | (F.col("warns") >= 2), "MEDIUM").otherwise("LOW")
    return out.withColumn("risk", risk)


def _pattern(p: str) -> str:
    """Java pattern of '/regex/flags' or of a plain phrase; case is ignored unless flags say otherwise."""
    import re

    m = re.fullmatch(r"/(.+)/([gimsuy]*)", p, re.S)
    if not m:
        return "(?i)" + re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", p)
    flags = "".join(f for f in (m[2] or "i") if f in "ims")
    return (f"(?{flags})" if flags else "") + m[1]


def _logic(node, context: dict[str, Column]) -> Column:
    """A boolean or value column of a rule's logic tree over the context's columns."""
    if isinstance(node, list):
        return F.array(*[_logic(n, context) for n in node])
    if not isinstance(node, dict):
        return F.lit(node)
    if "var" in node:
        return context.get(node["var"], F.lit(None))
    if "all" in node:
        return reduce(lambda a, b: a & b, [F.coalesce(_logic(n, context), F.lit(False)) for n in node["all"]], F.lit(True))
    if "any" in node:
        return reduce(lambda a, b: a | b, [F.coalesce(_logic(n, context), F.lit(False)) for n in node["any"]], F.lit(False))
    if "eq" in node:
        return _logic(node["eq"][0], context).eqNullSafe(_logic(node["eq"][1], context))
    if "ne" in node:
        return ~_logic(node["ne"][0], context).eqNullSafe(_logic(node["ne"][1], context))
    if "in" in node:
        return F.coalesce(F.array_contains(_logic(node["in"][1], context), _logic(node["in"][0], context)), F.lit(False))
    if "contains" in node:
        return F.coalesce(F.array_contains(_logic(node["contains"][0], context), _logic(node["contains"][1], context)), F.lit(False))
    return F.lit(False)


#: Characters in which an evidence and what stands around it are looked for.
_NEAR = 4096


def _place(t: Column, lowered: Column, p: str) -> Column:
    """Where the rule's pattern or phrase first stands, from 1; nowhere: 0. Phrases are searched in the lower-case text."""
    return F.regexp_instr(t, F.lit(_pattern(p))) if p.startswith("/") else F.position(F.lit(p.lower()), lowered)


def evaluate_playbook(docs: DataFrame, rules: list[dict], id_col: str = "doc_id", text_col: str = "text", head: int | None = 1200) -> DataFrame:
    """(doc_id, rule_id, clause, level, severity, status, evidence): every rule on every text, in one projection.

    Fails if a required pattern is missing, a forbidden one is there, or failIf holds; review if `when` doesn't hold or
    nothing is checked. Evidence is the first match with 160 characters on either side: each pattern is located once, and
    the evidence cut from around that place. `head` is contract_context()'s.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    context = {"context.parties": F.col("c.parties"), "context.partyStates": F.col("c.party_states"), "context.governingLaw.state": F.col("c.governing_law"), "context.venue.state": F.col("c.venue_state"), "context.venue.city": F.col("c.venue_city")}
    patterns = list(dict.fromkeys(p for r in rules for p in (*r.get("require", []), *r.get("forbid", []))))
    at = {p: F.col("at")[i] for i, p in enumerate(patterns)}
    rows = spread(docs.select(id_col, text_col)).select(F.col(id_col).alias("doc_id"), t.alias("t"), F.lower(t).alias("low"), contract_context(F.col(text_col), head).alias("c"))
    places = F.array(*[_place(F.col("t"), F.col("low"), p) for p in patterns]) if patterns else F.array().cast("array<int>")
    rows = rows.select("doc_id", "t", "c", places.alias("at"))
    made = []
    for r in rules:
        need, ban = r.get("require", []), r.get("forbid", [])
        missing = reduce(lambda a, b: a | b, [at[p] == 0 for p in need], F.lit(False))
        banned = reduce(lambda a, b: a | b, [at[p] > 0 for p in ban], F.lit(False))
        failing = F.coalesce(_logic(r["failIf"], context), F.lit(False)) if r.get("failIf") else F.lit(False)
        status = F.when(missing | banned | failing, "fail").otherwise("pass")
        if r.get("when"):
            status = F.when(~F.coalesce(_logic(r["when"], context), F.lit(False)), "review").otherwise(status)
        elif not need and not ban and not r.get("failIf"):
            status = F.lit("review")
        around = F.lit("")
        for p in (need[:1] or ban[:1]):
            near = F.substr("t", F.greatest(at[p] - 320, F.lit(1)), F.lit(_NEAR))
            around = F.when(at[p] > 0, F.regexp_extract(near, "(?is)(.{0,160}(?:" + _pattern(p).removeprefix("(?i)") + ").{0,160})", 1)).otherwise("")
        made.append(F.struct(F.lit(r["id"]).alias("rule_id"), F.lit(r.get("clause", "")).alias("clause"), F.lit(r.get("level", "")).alias("level"), F.lit(int(r.get("severity", 0))).alias("severity"), status.alias("status"), F.nullif(F.trim(F.regexp_replace(around, r"\s+", " ")), F.lit("")).alias("evidence")))
    return rows.select("doc_id", F.explode(F.array(*made)).alias("r")).select("doc_id", "r.*")


def playbook_review(docs: DataFrame, rules: list[dict], head: int | None = 1200) -> DataFrame:
    return risk_rollup(evaluate_playbook(docs, rules, head=head))
