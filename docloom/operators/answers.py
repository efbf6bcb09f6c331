"""What models answer: reading and checking rows, normal forms, criteria met, precision and recall, and runs compared.

The tables below are small answers and references given in code; every rule is a projection or an aggregate over any such table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import plain, texts
from docloom.functions.tables import given

#: Categories and statuses of requirement rows.
CATEGORIES = "security infrastructure sla hr financial eligibility functional technical delivery process".split()
STATUSES = "mandatory recommended unspecified".split()
#: Categories of criteria, and words that stand for them; families are searched in the order given.
FAMILIES = "equipe sla cout dossier entreprise solution".split()
CATEGORY_WORDS = [
    ("performance", "solution"), ("technology", "solution"), ("technologie", "solution"), ("skill", "equipe"), ("competence", "equipe"), ("certification", "equipe"), ("personnel", "equipe"), ("staff", "equipe"), ("team", "equipe"),
    ("duree", "sla"), ("delai", "sla"), ("deadline", "sla"), ("temps", "sla"), ("prix", "cout"), ("price", "cout"), ("licence", "cout"), ("vendor", "entreprise"), ("fournisseur", "entreprise"), ("company", "entreprise"),
    ("document", "dossier"), ("livrable", "dossier"), ("submission", "dossier"), ("proposal", "dossier"),
]
#: Words that stand for a status, in the order searched.
STATUS_WORDS = [
    ("obligatoire", "obligatoire"), ("mandatory", "obligatoire"), ("must", "obligatoire"), ("shall", "obligatoire"), ("required", "obligatoire"), ("require", "obligatoire"), ("yes", "obligatoire"), ("oui", "obligatoire"), ("recommande", "recommande"),
    ("recommended", "recommande"), ("should", "recommande"), ("preferably", "recommande"), ("preferred", "recommande"), ("optional", "recommande"), ("non precise", "non precise"), ("unspecified", "non precise"), ("not specified", "non precise"), ("n a", "non precise"),
]


def _rows(spark) -> DataFrame:
    """(label, row, problem): a row of each answer's list as text, or what is wrong with the answer."""
    v = given(spark, ANSWERS, "label string, raw string").withColumn("v", F.try_parse_json(texts.unfenced(F.col("raw"))))
    lists = """CASE WHEN schema_of_variant(v) LIKE 'ARRAY%' THEN try_variant_get(v, '$', 'array<variant>')
        WHEN schema_of_variant(v) LIKE 'OBJECT%' THEN try_variant_get(get(filter(map_values(try_variant_get(v, '$', 'map<string,variant>')), x -> schema_of_variant(x) LIKE 'ARRAY%'), 0), '$', 'array<variant>') END"""
    r = v.withColumn("rows", F.expr(lists)).select("label", F.when(F.col("v").isNull(), "unreadable").when(F.col("rows").isNull(), "wrong root").alias("bad"), F.explode_outer("rows").alias("x"))
    field = lambda c: F.trim(F.coalesce(F.expr(f"try_variant_get(x, '$.{c}', 'string')"), F.lit("")))
    problem = F.when(F.col("bad").isNotNull(), F.col("bad")).when(~F.expr("schema_of_variant(x)").like("OBJECT%"), "no object").when(field("requirement") == "", "empty")
    return r.where("bad is not null or x is not null").select("label", problem.alias("problem"), *(field(c).alias(c) for c in ("requirement", "category", "status", "passage")))


def answer_rows(spark, at):
    """fit rows, with categories and statuses out of the lists replaced."""
    c, s = texts.fold(F.col("category")), texts.fold(F.col("status"))
    return _rows(spark).where("problem is null").select("label", "requirement", F.when(c.isin(CATEGORIES), c).otherwise("process").alias("category"), F.when(s.isin(STATUSES), s).otherwise("unspecified").alias("status"))


def answer_problems(spark, at):
    """every departure counted."""
    r = _rows(spark)
    fit = F.col("problem").isNull()
    found = F.array_compact(F.array(F.col("problem"), F.when(fit & ~texts.fold(F.col("category")).isin(CATEGORIES), "category"), F.when(fit & ~texts.fold(F.col("status")).isin(STATUSES), "status"), F.when(fit & (F.col("passage") != "") & (F.col("passage") != F.col("label")), "label")))
    return r.select(F.explode(found).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


def _plain_form(c):
    return F.trim(F.regexp_replace(texts.fold(F.trim(c)), "[^a-z0-9 ]", " "))


def normal_forms(spark, at):
    """category and status of six and three, by name, by word, by family, and to be read again where nothing fits."""
    r = given(spark, FORMS, "pos long, text string, category string, status string").where(F.length(F.trim("text")) >= 5)
    c, s = _plain_form(F.col("category")), _plain_form(F.col("status"))
    known = F.coalesce(*(F.when(c == w, F.lit(x)) for w, x in CATEGORY_WORDS))
    held = F.coalesce(*(F.when(F.contains(c, F.lit(w)), F.lit(x)) for family in FAMILIES for w, x in CATEGORY_WORDS if x == family))
    named = F.coalesce(*(F.when(F.contains(c, F.lit(x)), F.lit(x)) for x in FAMILIES))
    category = F.when(c.isin(FAMILIES), c).otherwise(F.coalesce(known, held, named, F.lit("autre")))
    exact = F.coalesce(*(F.when(s == w, F.lit(x)) for w, x in STATUS_WORDS))
    near = F.coalesce(*(F.when(F.contains(s, F.lit(w)), F.lit(x)) for w, x in STATUS_WORDS))
    status = F.when(s == "", "non precise").otherwise(F.coalesce(exact, near, F.lit("non precise")))
    again = (category == "autre") | ((s != "") & exact.isNull() & near.isNull())
    return r.select("pos", category.alias("category"), status.alias("status"), again.alias("read_again"), F.when(c != category, F.trim("category")).alias("category_as_given"), F.when(s != status, F.trim("status")).alias("status_as_given"))


def category_rows(spark, at):
    """rows of one category: a text of eight characters at least, a known section or none, the status by the words it holds."""
    r = given(spark, FORMS, "pos long, text string, category string, status string")
    s = texts.fold(F.trim("status"))
    has = lambda words: F.exists(texts.array(words), lambda w: F.contains(s, w))
    status = F.when(s.isin("obligatoire", "recommande", "non precise"), s).when(has(["must", "shall", "mandatory", "required", "oblig"]), "obligatoire").when(has(["should", "recommend", "prefer", "recomm"]), "recommande").otherwise("non precise")
    section = F.trim("category")
    return r.select("pos", (F.length(F.trim("text")) >= 8).alias("fit"), status.alias("status"), F.when(section.isin("sla", "team", "cost"), section).otherwise("").alias("section"))


def requirement_totals(spark, at):
    """Fit rows of each category, none counted as 0, and the share of rows whose words repeat another's."""
    fit = answer_rows(spark, at)
    n = fit.groupBy("category").agg(F.count("*").alias("n"), F.countDistinct(texts.fold(F.col("requirement"))).alias("distinct_n"))
    every = spark.createDataFrame([(c,) for c in CATEGORIES], "category string")
    return every.join(n, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") > 0, F.round(1 - F.col("distinct_n") / F.col("n"), 3)).alias("repeated"))


def _criteria(spark):
    return given(spark, CRITERIA, "id string, family string, groups array<string>")


def _met(groups, text):
    """each group, its aliases apart by bars, has an alias in the text."""
    return F.forall(groups, lambda g: F.exists(F.split(g, "[|]"), lambda a: F.contains(text, texts.fold(a))))


def _items(spark):
    """items of answers that are lists; (label, line)."""
    r = given(spark, REPLIES, "system string, run int, raw string, seconds double, context int").withColumn("v", F.try_parse_json(texts.unfenced(F.col("raw"))))
    items = "CASE WHEN schema_of_variant(v) LIKE 'ARRAY%' THEN try_variant_get(v, '$', 'array<variant>') ELSE try_variant_get(v, '$.criteria', 'array<variant>') END"
    return r.withColumn("items", F.expr(items))


def keyword_scores(spark, at):
    """Recall of each answer over its whole text, precision over the items of its list, null where it is none."""
    r = _items(spark).withColumn("text", texts.fold(texts.squeezed(F.col("raw"))))
    c = F.broadcast(_criteria(spark))
    recall = r.select("system", "run", "text").join(c, _met(F.col("groups"), F.col("text")), "left").groupBy("system", "run").agg(F.count("id").alias("found"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))
    line = r.where("items is not null").select("system", "run", F.posexplode("items").alias("k", "x")).select("system", "run", "k", texts.fold(F.concat_ws(" ", *(F.expr(f"try_variant_get(x, '$.{f}', 'string')") for f in ("name", "value")))).alias("line"))
    hit = line.join(c, _met(F.col("groups"), F.col("line")), "left").groupBy("system", "run", "k").agg((F.count("id") > 0).alias("hit"))
    precision = hit.groupBy("system", "run").agg(F.count("*").alias("items"), F.sum(F.col("hit").cast("int")).alias("matched"))
    total = _criteria(spark).agg(F.count("*").alias("total"))
    out = recall.join(precision, ["system", "run"], "left").join(F.broadcast(total))
    return out.select("system", "run", "found", "ids", F.round(F.col("found") / F.col("total"), 3).alias("recall"), "items", F.round(F.col("matched") / F.col("items"), 3).alias("precision"))


def family_recall(spark, at):
    """Recall of each answer by family of criteria."""
    r = _items(spark).select("system", "run", texts.fold(texts.squeezed(F.col("raw"))).alias("text"))
    return r.join(F.broadcast(_criteria(spark))).groupBy("system", "run", "family").agg(F.round(F.avg(_met(F.col("groups"), F.col("text")).cast("double")), 2).alias("recall"))


def run_report(spark, at):
    """Runs of a system together: mean, range, whether they conclude, durations without outliers, criteria that
    all runs miss, that some find and that come and go, and warnings."""
    s = keyword_scores(spark, at).join(given(spark, [r[:2] + r[3:] for r in REPLIES], "system string, run int, seconds double, context int"), ["system", "run"])
    least = F.min("seconds").over(Window.partitionBy("system"))
    s = s.withColumn("apart", F.col("seconds") > 5 * least)
    ids = _criteria(spark).agg(F.collect_list("id").alias("all_ids"))
    first = F.min_by("ids", "run")
    g = s.groupBy("system").agg(F.count("*").alias("runs"), F.round(F.avg("recall"), 3).alias("mean"), F.min("recall").alias("low"), F.max("recall").alias("high"), F.round(F.avg("precision"), 3).alias("precision"), F.round(F.avg(F.when(~F.col("apart"), F.col("seconds")))).alias("seconds"),
                                F.count(F.when(F.col("apart"), 1)).alias("outliers"), F.count(F.when(F.col("seconds").isNull(), 1)).alias("untimed"), F.count(F.when(F.col("items").isNull(), 1)).alias("no_list"), F.countDistinct("context").alias("contexts"),
                                F.array_distinct(F.flatten(F.collect_list(F.split("ids", ",")))).alias("some"), F.split(first, ",").alias("first_ids")).join(F.broadcast(ids))
    span = F.round(F.col("high") - F.col("low"), 3)
    missed = F.array_except("all_ids", "some")
    unstable = F.array_except(F.filter("some", lambda x: x != ""), F.col("first_ids"))
    warn = F.array_compact(F.array(F.when(span > 0.10, "range"), F.when(F.col("outliers") > 0, "outlier"), F.when(F.col("untimed") > 0, "untimed"), F.when(F.col("no_list") > 0, "no list"), F.when(F.col("contexts") > 1, "contexts")))
    text = lambda a: F.array_join(F.array_sort(a), ",")
    return g.select("system", "runs", "mean", "low", "high", span.alias("span"), (span <= 0.10).alias("concludes"), "precision", "seconds", "outliers", text(missed).alias("always_missed"), text(unstable).alias("unstable"), F.array_join(warn, ",").alias("warnings"))


def text_functions(spark, at):
    """S1 to S4, S8 to S10 and F2 over the strings below."""
    t = given(spark, STRINGS, "pos long, text string, section string, title string, seconds double, day string")
    return t.select("pos", texts.predicate(F.col("text")).alias("predicate"), texts.valid_argument(F.col("text")).alias("valid"), texts.unfenced(F.col("text")).alias("unfenced"), texts.braced(F.col("text")).alias("braced"), texts.source_label(F.col("section"), F.col("title")).alias("label"),
                    texts.duration(F.col("seconds")).alias("took"), F.date_format(F.to_date("day"), "dd/MM/yyyy").alias("written"))


ANSWERS = [
    ("P1", '{"rows": [{"requirement": "Backups every night", "category": "Security", "status": "mandatory", "passage": "P1"}, {"requirement": "Two engineers", "category": "hr", "status": "must"}]}'),
    ("P2", '```json\n[{"requirement": "  ", "category": "sla"}, 3, "x", {"requirement": "Four hours response", "category": "SLA", "status": "Mandatory", "passage": "P9"}, {"requirement": "four hours response", "category": "sla", "status": "recommended"}]\n```'),
    ("P3", "not json at all {"), ("P4", '{"note": "nothing", "count": 3}'), ("P5", "3"), ("P6", '{"criteria": []}'), ("P7", '[{"requirement": "Price in euros", "category": "money", "status": null}, {"category": "hr"}]'), ("P8", '{"meta": {"a": 1}, "list": [{"requirement": "Logs kept", "category": "sécurity", "status": "unspecified"}]}'),
]
FORMS = [
    (1, "Five engineers", "équipe", "Mandatory"), (2, "Price per user", "Prix / licence", "shall be"), (3, "Skill and technology", "skill/technology", "preferably"), (4, "abc", "sla", "must"), (5, "Unknown kind of thing", "weather", "perhaps"), (6, "Time of repair", "delai", ""), (7, "Proposal in three copies", "sla", "n/a"),
    (8, "Company profile", "Company profile", "recommandé"), (9, "Eight ch", "cost", "obligatoire"), (10, "Certified staff in team", "solutions", "NON PRÉCISÉ"), (11, "Nothing given", "", "Required"),
]
CRITERIA = [("C1", "team", ["engineer|ingénieur", "five|cinq"]), ("C2", "team", ["certified|certifié"]), ("C3", "sla", ["four hours|4 h"]), ("C4", "cost", ["euro|price"]), ("C5", "sla", ["backup", "night|nuit"])]
REPLIES = [
    ("alpha", 1, '[{"name": "Five engineers, certified", "value": "yes"}, {"name": "Weather", "value": "fine"}, {"name": "Response", "value": "four hours"}]', 10.0, 640), ("alpha", 2, '{"criteria": [{"name": "CINQ INGÉNIEURS", "value": null}, {"name": "Price in euros"}]}', 12.0, 640),
    ("alpha", 3, "Five engineers; four hours; the price is given in euros.", 90.0, 700), ("beta", 1, '```json\n[{"name": "Backups each night"}]\n```', None, 100), ("beta", 2, '[{"name": "Backup every night", "value": "price"}]', 8.0, 100), ("gamma", 1, "nothing at all", 3.0, 5),
]
STRINGS = [
    (1, "is the owner of the", "3.1", "Scope", 0.25, "2024-03-09"), (2, "  The ", "", "Scope", 12.4, "1999-12-31"), (3, "```json\n{\"a\": 1}\n```", "3", None, 125.0, None), (4, "see {\"a\": {\"b\": 2}} end", None, " ", 5400.0, "2020-02-29"), (5, "12.5 %", None, None, 59.0, "2021-01-01"), (6, "Été à Sète", " 4 ", "x", 60.0, "2021-01-01"),
]

_FENCE = "regexp_replace(trim(raw), '^```(json)?[ \\t\\n\\r]*|[ \\t\\n\\r]*```$', '', 'g')"
_A = plain.values(ANSWERS, "label string, raw string")
_LIST = "CASE WHEN json_type(j) = 'ARRAY' THEN j WHEN json_type(j) = 'OBJECT' THEN list_filter(list_transform(json_keys(j), lambda k: json_extract(j, '$.\"' || k || '\"')), lambda x: json_type(x) = 'ARRAY')[1] END"
_ROWS = f"""(SELECT label, CASE WHEN bad IS NOT NULL THEN bad WHEN json_type(x) <> 'OBJECT' THEN 'no object' WHEN trim(coalesce(x ->> '$.requirement', '')) = '' THEN 'empty' END AS problem, trim(coalesce(x ->> '$.requirement', '')) AS requirement, trim(coalesce(x ->> '$.category', '')) AS category,
    trim(coalesce(x ->> '$.status', '')) AS status, trim(coalesce(x ->> '$.passage', '')) AS passage FROM (SELECT label, 'unreadable' AS bad, NULL AS x FROM (SELECT label, try_cast({_FENCE} AS json) AS j FROM {_A} a) b WHERE j IS NULL UNION ALL
    SELECT label, 'wrong root', NULL FROM (SELECT label, {_LIST} AS l FROM (SELECT label, try_cast({_FENCE} AS json) AS j FROM {_A} a) b WHERE j IS NOT NULL) c WHERE l IS NULL UNION ALL
    SELECT label, NULL, unnest(from_json(l, '["json"]')) FROM (SELECT label, {_LIST} AS l FROM (SELECT label, try_cast({_FENCE} AS json) AS j FROM {_A} a) b WHERE j IS NOT NULL) c WHERE l IS NOT NULL) d)"""
_CAT, _STA = plain.fold("category"), plain.fold("status")
_FIT = f"(SELECT label, requirement, CASE WHEN {_CAT} IN {plain.listed(CATEGORIES)} THEN {_CAT} ELSE 'process' END AS category, CASE WHEN {_STA} IN {plain.listed(STATUSES)} THEN {_STA} ELSE 'unspecified' END AS status FROM {_ROWS} r WHERE problem IS NULL)"
_FORM = plain.values(FORMS, "pos long, text string, category string, status string")


def _form(x: str) -> str:
    return f"trim(regexp_replace({plain.fold(f'trim({x})')}, '[^a-z0-9 ]', ' ', 'g'))"


_WORD = lambda words: plain.values([(i, *w) for i, w in enumerate(words)], "k long, w string, x string")
_BY = "(SELECT min_by(x, {order}) FROM {words} q WHERE {test})"
_ORDERED = [(w, x) for family in FAMILIES for w, x in CATEGORY_WORDS if x == family]
_CATEGORY = f"CASE WHEN c IN {plain.listed(FAMILIES)} THEN c ELSE coalesce({_BY.format(order='k', words=_WORD(CATEGORY_WORDS), test='c = w')}, {_BY.format(order='k', words=_WORD(_ORDERED), test='contains(c, w)')}, {_BY.format(order='k', words=_WORD([(f, f) for f in FAMILIES]), test='contains(c, w)')}, 'autre') END"
_EXACT, _NEAR = (_BY.format(order="k", words=_WORD(STATUS_WORDS), test=t) for t in ("s = w", "contains(s, w)"))
_STATUS = f"CASE WHEN s = '' THEN 'non precise' ELSE coalesce({_EXACT}, {_NEAR}, 'non precise') END"
_C = plain.values(CRITERIA, "id string, family string, groups array<string>")
_R = plain.values(REPLIES, "system string, run int, raw string, seconds double, context int")
_TEXT = plain.fold("trim(regexp_replace(raw, '[ \\t\\n\\r]+', ' ', 'g'))")
_IN = "len(list_filter(groups, lambda g: len(list_filter(string_split(g, '|'), lambda a: contains({0}, strip_accents(lower(a))))) > 0)) = len(groups)"
_FOUND = f"(SELECT r.system, r.run, count(c.id) AS found, coalesce(string_agg(c.id, ',' ORDER BY c.id), '') AS ids FROM (SELECT *, {_TEXT} AS t FROM {_R} r) r LEFT JOIN {_C} c ON {_IN.format('t')} GROUP BY r.system, r.run)"
_ITEMS = f"(SELECT system, run, unnest(from_json(l, '[\"json\"]')) AS x FROM (SELECT system, run, CASE WHEN json_type(j) = 'ARRAY' THEN j ELSE json_extract(j, '$.criteria') END AS l FROM (SELECT system, run, try_cast({_FENCE} AS json) AS j FROM {_R} r) a WHERE j IS NOT NULL) b WHERE l IS NOT NULL)"
_PRECISE = f"(SELECT system, run, count(*) AS items, sum(CASE WHEN hit THEN 1 ELSE 0 END) AS matched FROM (SELECT i.system, i.run, i.k, count(c.id) > 0 AS hit FROM (SELECT system, run, row_number() OVER () AS k, {plain.fold(chr(40) + 'concat_ws(' + repr(' ') + ', x ->> ' + repr('$.name') + ', x ->> ' + repr('$.value') + '))')} AS line FROM {_ITEMS} x) i LEFT JOIN {_C} c ON {_IN.format('line')} GROUP BY i.system, i.run, i.k) h GROUP BY system, run)"
_SCORES = f"(SELECT f.system, f.run, found, ids, round(found / {len(CRITERIA)}, 3) AS recall, items, round(matched / items, 3) AS precision FROM {_FOUND} f LEFT JOIN {_PRECISE} p ON p.system = f.system AND p.run = f.run)"
_ALL_IDS = "[" + ", ".join(f"'{c[0]}'" for c in CRITERIA) + "]"
_G = f"""(SELECT s.system, count(*) AS runs, round(avg(recall), 3) AS mean, min(recall) AS low, max(recall) AS high, round(max(recall) - min(recall), 3) AS span, round(avg(precision), 3) AS precision, round(avg(CASE WHEN NOT apart THEN seconds END)) AS seconds, count(CASE WHEN apart THEN 1 END) AS outliers,
    count(CASE WHEN seconds IS NULL THEN 1 END) AS untimed, count(CASE WHEN items IS NULL THEN 1 END) AS no_list, count(DISTINCT context) AS contexts, list_filter(list_distinct(flatten(list(string_split(ids, ',')))), lambda x: x <> '') AS any_run, string_split(min_by(ids, s.run), ',') AS first_ids
    FROM (SELECT s.*, r.seconds, r.context, r.seconds > 5 * min(r.seconds) OVER (PARTITION BY s.system) AS apart FROM {_SCORES} s JOIN {_R} r ON r.system = s.system AND r.run = s.run) s GROUP BY s.system)"""
QUERIES = {f.__name__: f for f in (answer_rows, answer_problems, normal_forms, category_rows, requirement_totals, keyword_scores, family_recall, run_report, text_functions)}
ORACLES = {
    "answer_rows": f"SELECT * FROM {_FIT} f",
    "answer_problems": f"SELECT problem, count(*) AS n FROM (SELECT problem FROM {_ROWS} a WHERE problem IS NOT NULL UNION ALL SELECT 'category' FROM {_ROWS} a WHERE problem IS NULL AND {_CAT} NOT IN {plain.listed(CATEGORIES)} UNION ALL SELECT 'status' FROM {_ROWS} a WHERE problem IS NULL AND {_STA} NOT IN {plain.listed(STATUSES)} UNION ALL SELECT 'label' FROM {_ROWS} a WHERE problem IS NULL AND passage <> '' AND passage <> label) p GROUP BY problem",
    "normal_forms": f"SELECT pos, category, status, category = 'autre' OR (s <> '' AND {_EXACT} IS NULL AND {_NEAR} IS NULL) AS read_again, CASE WHEN c <> category THEN given END AS category_as_given, CASE WHEN s <> status THEN said END AS status_as_given FROM (SELECT pos, c, s, given, said, {_CATEGORY} AS category, {_STATUS} AS status FROM (SELECT pos, trim(category) AS given, trim(status) AS said, {_form('category')} AS c, {_form('status')} AS s FROM {_FORM} f WHERE length(trim(text)) >= 5) a) b",
    "category_rows": f"SELECT pos, length(trim(text)) >= 8 AS fit, CASE WHEN s IN ('obligatoire', 'recommande', 'non precise') THEN s WHEN regexp_matches(s, 'must|shall|mandatory|required|oblig') THEN 'obligatoire' WHEN regexp_matches(s, 'should|recommend|prefer|recomm') THEN 'recommande' ELSE 'non precise' END AS status, CASE WHEN trim(category) IN ('sla', 'team', 'cost') THEN trim(category) ELSE '' END AS section FROM (SELECT *, {plain.fold('trim(status)')} AS s FROM {_FORM} f) a",
    "requirement_totals": f"SELECT c.x AS category, count(f.label) AS n, CASE WHEN count(f.label) > 0 THEN round(1 - count(DISTINCT {plain.fold('requirement')}) / count(f.label), 3) END AS repeated FROM {plain.values([(c,) for c in CATEGORIES], 'x string')} c LEFT JOIN {_FIT} f ON f.category = c.x GROUP BY c.x",
    "keyword_scores": f"SELECT system, run, found, ids, recall, items, precision FROM {_SCORES} s",
    "family_recall": f"SELECT system, run, family, round(avg(CASE WHEN {_IN.format('t')} THEN 1.0 ELSE 0.0 END), 2) AS recall FROM (SELECT *, {_TEXT} AS t FROM {_R} r) r, {_C} c GROUP BY system, run, family",
    "run_report": f"SELECT system, runs, mean, low, high, span, span <= 0.10 AS concludes, precision, seconds, outliers, array_to_string(list_sort(list_filter({_ALL_IDS}, lambda x: NOT list_contains(any_run, x))), ',') AS always_missed, array_to_string(list_sort(list_filter(any_run, lambda x: NOT list_contains(first_ids, x))), ',') AS unstable, array_to_string(list_filter([CASE WHEN span > 0.10 THEN 'range' END, CASE WHEN outliers > 0 THEN 'outlier' END, CASE WHEN untimed > 0 THEN 'untimed' END, CASE WHEN no_list > 0 THEN 'no list' END, CASE WHEN contexts > 1 THEN 'contexts' END], lambda x: x IS NOT NULL), ',') AS warnings FROM {_G} g",
    "text_functions": f"""SELECT pos, {plain.predicate('text')} AS predicate, {plain.valid_argument('text')} AS valid, {_FENCE.replace('raw', 'text')} AS unfenced, regexp_extract(text, '(?s)\\{{.*\\}}', 0) AS braced, coalesce(nullif(concat_ws(' ', nullif(trim(section), ''), nullif(trim(title), '')), ''), '?') AS label,
        CASE WHEN seconds < 1 THEN cast(round(seconds * 1000) AS int) || ' ms' WHEN seconds < 60 THEN cast(round(seconds) AS int) || ' s' WHEN seconds < 3600 THEN cast(round(seconds / 60) AS int) || ' min' ELSE printf('%.1f', seconds / 3600) || ' h' END AS took, strftime(cast(day AS date), '%d/%m/%Y') AS written FROM {plain.values(STRINGS, 'pos long, text string, section string, title string, seconds double, day string')} s""",
}
