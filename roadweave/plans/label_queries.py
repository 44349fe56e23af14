"""Names as they are read, searched and shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..sources.lattice import Network
from .catalogue import query

#: Names of the kinds that occur in source data, one to each part in turn.
SPELLINGS = ("SH 1", "State Highway 3", "SH 16/47", "016-0047-R1", "Sh 67 Buller Road", "Essex St (Sh 1)", "ST HELIERS RD", "  Queen   Street ", "MSR 20A", "SH1N RS 12", "SH 2 On Ramp", "Mangamōteo Ave")
_NAMES = ", nm AS (SELECT p_partkey, (" + repr(list(SPELLINGS)) + ")[p_partkey % 12 + 1] AS name FROM part)"


def spelled(net: Network) -> DataFrame:
    return net.table("part").select("p_partkey", F.element_at(F.array(*map(F.lit, SPELLINGS)), (F.col("p_partkey") % 12 + 1).cast("int")).alias("name"))


@query(_NAMES + "\nSELECT p_partkey, trim(regexp_replace(strip_accents(name), '\\s+', ' ', 'g')) AS folded FROM nm")
def fn_fold_ascii(net: Network) -> DataFrame:
    return spelled(net).select("p_partkey", N.fold_ascii("name").alias("folded"))


_TYPES = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in N.ROAD_TYPES.items()) + "}"


@query(_NAMES + """, tk AS (SELECT p_partkey, regexp_extract_all(lower(regexp_replace(strip_accents(name), '[(][^)]*[)]', ' ', 'g')), '[a-z0-9]+') AS t FROM nm)
SELECT p_partkey, array_to_string(list_transform(t, lambda w, i: CASE WHEN w = 'st' THEN CASE WHEN i = 1 AND len(t) > 1 THEN 'saint' ELSE 'street' END ELSE coalesce(""" + _TYPES + """[w], w) END), ' ') AS key FROM tk""")
def fn_search_key(net: Network) -> DataFrame:
    """Keys under which two spellings of a name meet, with road types written out."""
    return spelled(net).select("p_partkey", N.search_key("name").alias("key"))


_HIGHWAY = r"(?i)^\s*(?:SH|MSR|State\s+Highway)\s*#?\s*([0-9]+)(?:[^A-Za-z0-9]|$|[A-Za-z](?:[^A-Za-z]|$))"
_SECTION = r"(?i)^\s*([0-9]{2,3})[A-Za-z]?-[0-9]{3,4}"
_CODES = "[" + ", ".join(f"'{w}'" for w in N.CODE_WORDS) + "]"
_ROUTE = _NAMES + f""", rt AS (
  SELECT p_partkey, name, nullif(TRY_CAST(coalesce(nullif(regexp_extract(name, '{_HIGHWAY}', 1), ''), nullif(regexp_extract(name, '{_SECTION}', 1), '')) AS INTEGER), 0) AS number, regexp_matches(name, '{_HIGHWAY}') OR regexp_matches(name, '{_SECTION}') AS starts,
    regexp_matches(name, '(?i)^\\s*(?:SH|MSR|State\\s+Highway)\\s*#?\\s*[0-9]+[A-Za-z]?\\s*/\\s*[0-9]') AS station,
    regexp_extract_all(lower(regexp_replace(regexp_replace(name, '(?i)^\\s*(?:(?:SH|MSR|State\\s+Highway)\\s*#?\\s*[0-9]+[A-Za-z]?|[0-9]{{2,3}}[A-Za-z]?-[0-9]{{3,4}})', ''), '[(][^)]*[)]', ' ', 'g')), '[a-z]+') AS rest FROM nm
), rd AS (SELECT *, starts AND (station OR len(list_filter(rest, lambda w: NOT list_contains({_CODES}, w))) = 0) AS designation FROM rt)"""


@query(_ROUTE + "\nSELECT p_partkey, starts, number, designation, CASE WHEN number IS NOT NULL THEN 'State Highway ' || number END AS formatted FROM rd")
def fn_route_number(net: Network) -> DataFrame:
    """Route references: whether a name opens with one, its number, whether it is nothing else."""
    return spelled(net).select("p_partkey", N.starts_with_route("name").alias("starts"), N.route_number("name").alias("number"), N.is_designation("name").alias("designation"), N.designation(N.route_number("name")).alias("formatted"))


@query(_ROUTE + "\nSELECT p_partkey, CASE WHEN designation AND number IS NOT NULL THEN 'State Highway ' || number ELSE nullif(trim(name), '') END AS name FROM rd")
def fn_normalise_external(net: Network) -> DataFrame:
    return spelled(net).select("p_partkey", N.normalise_external("name").alias("name"))


@query(_NAMES + "\nSELECT p_partkey, regexp_matches(lower(name), '\\bramp\\b') AS ramp FROM nm")
def fn_ramp_name(net: Network) -> DataFrame:
    return spelled(net).select("p_partkey", N.is_ramp_name("name").alias("ramp"))


#: What is known of each link beside its name, by rule: authority, localities and a braced source id.
_KNOWN = """, kn AS (
  SELECT *, CASE link_id // 5 % 4 WHEN 0 THEN 'Waitomo District Council' WHEN 1 THEN 'Port Road Limited' WHEN 2 THEN 'Highways' END AS rca_name, CASE WHEN link_id % 3 = 0 THEN 'Kinleith' WHEN link_id % 3 = 1 THEN ' ' END AS left_locality,
    CASE WHEN link_id // 5 % 3 = 0 THEN 'Tokoroa' WHEN link_id // 5 % 3 = 1 THEN 'Kinleith' END AS right_locality, '{' || substr(md5(CAST(link_id AS VARCHAR)), 1, 8) || '-4e1f}' || CASE WHEN link_id % 2 = 0 THEN '#' || (link_id % 4) ELSE '' END AS source_id FROM links
), hp AS (SELECT *, CASE WHEN rca_name IS NOT NULL THEN nullif(trim(regexp_replace(rca_name, ' (Council|Corporation|Limited|Ltd)$', '')), '') END AS authority, nullif(trim(left_locality), '') AS l, nullif(trim(right_locality), '') AS r,
  substr(md5(CAST(link_id AS VARCHAR)), 1, 8) || CASE WHEN link_id % 2 = 0 THEN '#' || (link_id % 4) ELSE '' END AS identifier FROM kn),
lp AS (SELECT *, CASE WHEN l <> r THEN 'between ' || least(l, r) || ' and ' || greatest(l, r) WHEN coalesce(l, r) IS NOT NULL THEN 'near ' || coalesce(l, r) END AS place FROM hp)"""


def known(net: Network) -> DataFrame:
    i = F.col("link_id")
    k, t = F.floor(i / 5) % 4, F.floor(i / 5) % 3
    n = net.links.withColumns(
        {
            "rca_name": F.when(k == 0, "Waitomo District Council").when(k == 1, "Port Road Limited").when(k == 2, "Highways"),
            "left_locality": F.when(i % 3 == 0, "Kinleith").when(i % 3 == 1, " "),
            "right_locality": F.when(t == 0, "Tokoroa").when(t == 1, "Kinleith"),
            "source_id": F.concat(F.lit("{"), F.substring(F.md5(i.cast("string")), 1, 8), F.lit("-4e1f}"), F.when(i % 2 == 0, F.concat(F.lit("#"), (i % 4).cast("string"))).otherwise("")),
        }
    )
    return n.withColumns({"authority": N.short_authority(F.col("rca_name")), "place": N.locality_phrase(F.col("left_locality"), F.col("right_locality")), "identifier": N.short_identifier(F.col("source_id"), i)})


@query(_KNOWN + "\nSELECT link_id, authority, identifier, place FROM lp")
def fn_label_helpers(net: Network) -> DataFrame:
    return known(net).select("link_id", "authority", "identifier", "place")


#: Governed names of source features and which sources may be shown, by rule on the group's hash.
_GOVERNED = _KNOWN + """, gh AS (SELECT closure_group_id AS g, CAST(ord(substr(md5(closure_group_id), 1, 1)) AS INTEGER) AS h, min(road_name) AS n FROM links GROUP BY 1),
ln AS (SELECT g, CASE WHEN h % 5 < 2 THEN n END AS display, CASE WHEN h % 5 >= 2 AND h % 5 < 4 THEN coalesce(n, 'Unrecorded') || ' East' END AS external,
  CASE h % 5 WHEN 2 THEN 'sections' WHEN 3 THEN 'carriageways' ELSE 'own' END AS source, CASE WHEN h % 5 < 2 AND n IS NOT NULL THEN 'named' WHEN h % 5 IN (2, 3) THEN CASE WHEN h % 2 = 0 THEN 'externally_enriched' ELSE 'officially_unnamed' END WHEN h % 3 = 0 THEN 'ambiguous_conflict' ELSE 'unresolved' END AS status,
  CASE WHEN h % 7 = 0 THEN 'State Highway ' || (h % 9) END AS route FROM gh WHERE h % 11 <> 0),
lc(source, cleared) AS (VALUES ('own', true), ('sections', true), ('carriageways', false)),
dn AS (SELECT l.link_id, CASE WHEN display IS NOT NULL THEN display WHEN external IS NOT NULL AND cleared THEN external WHEN g IS NULL THEN l.road_name END AS display_name,
  CASE WHEN status IS NULL THEN CASE WHEN l.road_name IS NULL THEN 'unresolved' ELSE 'named' END WHEN status IN ('externally_enriched', 'officially_unnamed') AND NOT cleared THEN 'unresolved' ELSE status END AS name_status,
  CASE WHEN ln.source <> 'own' AND NOT cleared THEN ln.source END AS withheld, CASE WHEN ln.source IS NULL OR ln.source = 'own' OR cleared THEN route END AS route
  FROM links l LEFT JOIN ln ON g = l.closure_group_id LEFT JOIN lc ON lc.source = ln.source)"""


def governed(net: Network) -> DataFrame:
    g = net.links.groupBy("closure_group_id").agg(F.min("road_name").alias("n")).withColumn("h", F.ascii(F.substring(F.md5("closure_group_id"), 1, 1)))
    h, n = F.col("h"), F.col("n")
    status = F.when((h % 5 < 2) & n.isNotNull(), "named").when((h % 5).isin(2, 3), F.when(h % 2 == 0, "externally_enriched").otherwise("officially_unnamed")).when(h % 3 == 0, "ambiguous_conflict").otherwise("unresolved")
    return g.where(h % 11 != 0).select(
        "closure_group_id",
        F.when(h % 5 < 2, n).alias("display"),
        F.when((h % 5).isin(2, 3), F.concat(F.coalesce(n, F.lit("Unrecorded")), F.lit(" East"))).alias("external"),
        F.when(h % 5 == 2, "sections").when(h % 5 == 3, "carriageways").otherwise("own").alias("source"),
        status.alias("status"),
        F.when(h % 7 == 0, F.concat(F.lit("State Highway "), (h % 9).cast("string"))).alias("route"),
    )


def shown(net: Network) -> DataFrame:
    """Names as licences let them be shown; a name that may not be is withheld, not missing."""
    licences = net.spark.createDataFrame([("own", True), ("sections", True), ("carriageways", False)], "source string, cleared boolean")
    names = governed(net).join(F.broadcast(licences), "source", "left")
    l = net.links.select("link_id", "closure_group_id", "road_name").join(names.withColumn("there", F.lit(True)), "closure_group_id", "left")
    cleared = F.coalesce("cleared", F.lit(False))
    name = F.when(F.col("display").isNotNull(), F.col("display")).when(F.col("external").isNotNull() & cleared, F.col("external")).when(F.col("there").isNull(), F.col("road_name"))
    status = F.when(F.col("status").isNull(), F.when(F.col("road_name").isNull(), "unresolved").otherwise("named")).when(F.col("status").isin("externally_enriched", "officially_unnamed") & ~cleared, "unresolved").otherwise(F.col("status"))
    other = F.coalesce(F.col("source") != "own", F.lit(False)) & ~cleared
    return l.select("link_id", name.alias("display_name"), status.alias("name_status"), F.when(other, F.col("source")).alias("withheld"), F.when(~other, F.col("route")).alias("route"))


@query(_GOVERNED + "\nSELECT * FROM dn")
def project_display_name(net: Network) -> DataFrame:
    return shown(net)


_LABEL = _GOVERNED + """, lb AS (SELECT k.link_id, CASE WHEN nullif(trim(display_name), '') IS NOT NULL THEN trim(display_name) WHEN route IS NOT NULL THEN route WHEN name_status = 'officially_unnamed' THEN 'Unnamed road' WHEN name_status = 'ambiguous_conflict' THEN 'Name disputed'
  WHEN withheld IS NOT NULL THEN 'Name withheld - ' || CASE WHEN rca_code = 1 THEN 'the highway authority' ELSE coalesce(authority, 'this road controlling authority') END WHEN rca_code = 1 THEN 'State-highway section' || coalesce(' ' || place, '')
  WHEN place IS NOT NULL THEN 'Local-road section ' || place WHEN authority IS NOT NULL THEN 'Road section managed by ' || authority ELSE identifier END AS label,
  CASE WHEN nullif(trim(display_name), '') IS NOT NULL THEN 'road_name' WHEN route IS NOT NULL THEN 'route_designation' WHEN name_status = 'officially_unnamed' THEN 'officially_unnamed' WHEN name_status = 'ambiguous_conflict' THEN 'conflict' WHEN withheld IS NOT NULL THEN 'withheld'
  WHEN rca_code = 1 OR place IS NOT NULL OR authority IS NOT NULL THEN 'contextual' ELSE 'identifier' END AS kind FROM lp k JOIN dn USING (link_id))"""


def labelled(net: Network) -> DataFrame:
    c = F.col
    k = known(net).join(shown(net), "link_id")
    k = k.withColumn("b", N.display_label(c("display_name"), c("route"), c("name_status"), c("withheld"), c("rca_code") == 1, c("authority"), c("place"), c("identifier")))
    return k.withColumns({"label": c("b.label"), "kind": c("b.kind")})


@query(_LABEL + "\nSELECT * FROM lb")
def project_label(net: Network) -> DataFrame:
    """The one label shown for each link: the first of eight that holds."""
    return labelled(net).select("link_id", "label", "kind")


@query(_LABEL + """\nSELECT lb.link_id, label, kind, floor(length_mm / 100.0 + 0.5) / 10 AS metres, CASE rca_code WHEN 1 THEN 'state highway' ELSE 'local road ' || rca_code END AS class, CASE WHEN oneway THEN 'one way' ELSE 'both ways' END AS directions FROM lb JOIN links USING (link_id)""")
def project_link_summary(net: Network) -> DataFrame:
    l = labelled(net)
    cls = F.when(F.col("rca_code") == 1, "state highway").otherwise(F.concat(F.lit("local road "), F.col("rca_code").cast("string")))
    return l.select("link_id", "label", "kind", (F.floor(F.col("length_mm") / 100.0 + 0.5) / 10).alias("metres"), cls.alias("class"), F.when(F.col("oneway"), "one way").otherwise("both ways").alias("directions"))


#: What users look for; a search returns its first fifty and says whether there were more.
TERMS = ("Row 1", "column 2", "east", "R-1", "highway")


@query(_GOVERNED + """, sq(term) AS (VALUES ('Row 1'), ('column 2'), ('east'), ('R-1'), ('highway')),
hit AS (SELECT term, l.link_id, rca_code, oneway, length_mm, CASE WHEN lower(display_name) = lower(term) THEN 0 WHEN lower(closure_group_id) = lower(term) THEN 1 WHEN display_name ILIKE term || '%' THEN 2 WHEN closure_group_id ILIKE term || '%' THEN 3 ELSE 4 END AS rank
  FROM sq, links l JOIN dn USING (link_id) WHERE display_name ILIKE '%' || term || '%' OR closure_group_id ILIKE '%' || term || '%'),
top AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY rank, rca_code = 1 DESC, NOT oneway DESC, length_mm DESC, link_id) AS place, count(*) OVER (PARTITION BY term) AS found FROM hit)
SELECT term, place, link_id, rank, found > 50 AS truncated FROM top WHERE place <= 50""")
def search_links(net: Network) -> DataFrame:
    """Links by what is typed: exact names, exact codes, names and codes that begin so, then any that
    hold it; highways and longer roads first among equals."""
    l = net.links.join(shown(net).select("link_id", "display_name"), "link_id")
    j = l.withColumn("term", F.explode(F.array(*map(F.lit, TERMS))))
    low = lambda c: F.lower(F.col(c))
    j = j.where(F.coalesce(F.contains(low("display_name"), low("term")), F.lit(False)) | F.contains(low("closure_group_id"), low("term")))
    begins = lambda c: F.coalesce(F.startswith(low(c), low("term")), F.lit(False))
    rank = F.when(low("display_name") == low("term"), 0).when(low("closure_group_id") == low("term"), 1).when(begins("display_name"), 2).when(begins("closure_group_id"), 3).otherwise(4)
    j = j.withColumn("rank", rank)
    w = Window.partitionBy("term").orderBy("rank", (F.col("rca_code") != 1), F.col("oneway"), F.desc("length_mm"), "link_id")
    top = j.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 51")
    more = top.groupBy("term").agg((F.max("place") > 50).alias("truncated"))
    return top.where("place <= 50").join(more, "term").select("term", "place", "link_id", "rank", "truncated")


@query(_KNOWN + """, rf AS (SELECT CASE WHEN link_id % 3 = 0 THEN source_id WHEN link_id % 3 = 1 THEN CAST(link_id AS VARCHAR) ELSE 'no ' || link_id END AS ref FROM kn)
SELECT ref, coalesce(a.link_id, b.link_id) AS link_id FROM (SELECT DISTINCT ref FROM rf) rf LEFT JOIN kn a ON a.source_id = ref LEFT JOIN kn b ON CAST(b.link_id AS VARCHAR) = ref""")
def resolve_ref(net: Network) -> DataFrame:
    """A reference is a source id, else a link's number, else unknown."""
    k = known(net)
    i = F.col("link_id")
    refs = k.select(F.when(i % 3 == 0, F.col("source_id")).when(i % 3 == 1, i.cast("string")).otherwise(F.concat(F.lit("no "), i.cast("string"))).alias("ref")).distinct()
    by_id = k.select(F.col("source_id").alias("ref"), i.alias("a"))
    by_number = k.select(i.cast("string").alias("ref"), i.alias("b"))
    return refs.join(by_id, "ref", "left").join(by_number, "ref", "left").select("ref", F.coalesce("a", "b").alias("link_id"))


@query(""", sn AS (SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'partial' WHEN 2 THEN 'failed' ELSE 'complete' END AS status, CASE n_regionkey WHEN 0 THEN 'national' WHEN 1 THEN 'regional' ELSE 'other' END AS coverage, n_nationkey % 7 = 0 AS transient FROM nation)
SELECT id, CASE WHEN status <> 'complete' THEN 'nothing complete' WHEN coverage = 'national' THEN 'newest complete national snapshot' ELSE 'regional fallback' END AS why FROM sn WHERE NOT transient AND status <> 'failed' ORDER BY CASE WHEN status = 'complete' AND coverage = 'national' THEN 0 WHEN status = 'complete' AND coverage = 'regional' THEN 1 ELSE 2 END, id DESC LIMIT 1""")
def filter_servable(net: Network) -> DataFrame:
    """The snapshot to serve: the newest complete national one, else regional, else whatever did not
    fail, said so. Copies made for a question never count."""
    k = F.col("n_nationkey")
    s = net.table("nation").select(k.alias("id"), F.when(k % 4 == 1, "partial").when(k % 4 == 2, "failed").otherwise("complete").alias("status"), F.when(F.col("n_regionkey") == 0, "national").when(F.col("n_regionkey") == 1, "regional").otherwise("other").alias("coverage"), (k % 7 == 0).alias("transient"))
    done = F.col("status") == "complete"
    order = F.when(done & (F.col("coverage") == "national"), 0).when(done & (F.col("coverage") == "regional"), 1).otherwise(2)
    best = s.where("NOT transient AND status <> 'failed'").orderBy(order, F.desc("id")).limit(1)
    return best.select("id", F.when(~done, "nothing complete").when(F.col("coverage") == "national", "newest complete national snapshot").otherwise("regional fallback").alias("why"))


@query(_GOVERNED + """\nSELECT rca_code, count(*) AS links, count(display_name) + count(withheld) AS known, count(display_name) AS shown, count(*) FILTER (withheld IS NOT NULL) AS withheld, count(DISTINCT closure_group_id) AS features FROM links JOIN dn USING (link_id) GROUP BY rca_code""")
def agg_naming_coverage(net: Network) -> DataFrame:
    """Names that are known, shown, and withheld by their sources' licences."""
    j = net.links.select("link_id", "rca_code", "closure_group_id").join(shown(net), "link_id")
    held = F.col("withheld").isNotNull()
    return j.groupBy("rca_code").agg(F.count("*").alias("links"), (F.count("display_name") + F.count("withheld")).alias("known"), F.count("display_name").alias("shown"), F.count_if(held).alias("withheld"), F.countDistinct("closure_group_id").alias("features"))
