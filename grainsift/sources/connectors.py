"""Connectors: payloads of public services as raw documents, and a paged source with replayable fetches.

A connector turns a frame with one payload (JSON or XML text) per row into raw documents. Fetching is separate:
the `paged` data source calls a fetch function by name, so tests and offline runs plug in stored pages.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pyspark.sql.window import Window

from grainsift.functions.text import OPEN_QUESTION_SIGNALS, contains_any, strip_tags

DEFAULTS = {
    "source": F.lit, "source_id": F.lit, "url": F.lit, "title": F.lit, "abstract": F.lit, "full_text": F.lit,
    "publication_date": F.lit, "document_type": F.lit,
}


def raw(df: DataFrame, **given: Column) -> DataFrame:
    """Rows in the raw-document layout; what is not given is empty."""
    text = [F.coalesce(given.get(c, F.lit("")), F.lit("")).alias(c) for c in DEFAULTS]
    none = F.array().cast("array<string>")
    lists = [F.coalesce(given.get(c, none), none).alias(c) for c in ("authors", "keywords")]
    return df.select(*text, *lists, F.coalesce(given.get("metadata", F.create_map().cast("map<string,string>")), F.create_map().cast("map<string,string>")).alias("metadata"))


def _meta(**kv: Column) -> Column:
    return F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v.cast("string"))])


ARTICLE = """MedlineCitation struct<PMID:string, Article:struct<ArticleTitle:string, Abstract:struct<AbstractText:array<struct<_Label:string,_VALUE:string>>>,
 AuthorList:struct<Author:array<struct<LastName:string,ForeName:string>>>, Journal:struct<JournalIssue:struct<PubDate:struct<Year:string,Month:string>>>,
 PublicationTypeList:struct<PublicationType:array<string>>>, MeshHeadingList:struct<MeshHeading:array<struct<DescriptorName:string>>>, KeywordList:struct<Keyword:array<string>>>"""


def pubmed_articles(payloads: DataFrame, column: str = "xml") -> DataFrame:
    """Article XML: labelled abstract sections, authors with a last name, year-month, headings then keywords."""
    a = payloads.select(F.from_xml(F.col(column), ARTICLE, {"valueTag": "_VALUE"}).alias("x")).select("x.MedlineCitation.*")
    sections = F.transform("Article.Abstract.AbstractText", lambda s: F.when(F.coalesce(s["_Label"], F.lit("")) != "", F.concat(s["_Label"], F.lit(": "), s["_VALUE"])).otherwise(s["_VALUE"]))
    named = F.filter("Article.AuthorList.Author", lambda p: F.coalesce(p["LastName"], F.lit("")) != "")
    empty = F.array().cast("array<string>")
    date = F.concat_ws("-", "Article.Journal.JournalIssue.PubDate.Year", "Article.Journal.JournalIssue.PubDate.Month")
    return raw(
        a, source=F.lit("pubmed"), source_id=F.concat(F.lit("PMID:"), "PMID"), url=F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), "PMID", F.lit("/")),
        title=F.col("Article.ArticleTitle"), abstract=F.array_join(sections, "\n"), authors=F.transform(named, lambda p: F.trim(F.concat(F.coalesce(p["ForeName"], F.lit("")), F.lit(" "), p["LastName"]))),
        publication_date=date, document_type=F.array_join("Article.PublicationTypeList.PublicationType", "; "),
        keywords=F.concat(F.coalesce(F.col("MeshHeadingList.MeshHeading.DescriptorName"), empty), F.coalesce(F.col("KeywordList.Keyword"), empty)), metadata=_meta(pmid=F.col("PMID")),
    )


ENTRY = """id string, title string, summary string, published string, author array<struct<name:string>>, `primary_category` struct<_term:string>, category array<struct<_term:string>>, link array<struct<_title:string,_href:string>>"""


def arxiv_entries(payloads: DataFrame, column: str = "xml") -> DataFrame:
    """Feed entries: id after /abs/, date, primary category first, PDF link if there is one."""
    e = payloads.select(F.from_xml(F.col(column), ENTRY, {"ignoreNamespace": "true"}).alias("x")).select("x.*")
    ident = F.substring_index("id", "/abs/", -1)
    cats = F.array_distinct(F.filter(F.concat(F.array(F.col("primary_category._term")), F.coalesce(F.col("category._term"), F.array().cast("array<string>"))), lambda c: c.isNotNull() & (c != "")))
    pdf = F.get(F.filter("link", lambda k: k["_title"] == "pdf"), 0)["_href"]
    return raw(
        e, source=F.lit("arxiv"), source_id=ident, url=F.coalesce(pdf, F.concat(F.lit("https://arxiv.org/abs/"), ident)), title=F.replace(F.trim("title"), F.lit("\n"), F.lit(" ")),
        abstract=F.trim("summary"), authors=F.filter("author.name", lambda n: n != ""), publication_date=F.substring("published", 1, 10), document_type=F.lit("preprint"), keywords=cats, metadata=_meta(arxiv_id=ident),
    )


def clinical_trials(payloads: DataFrame, column: str = "json") -> DataFrame:
    """Studies of a registry page."""
    schema = """studies array<struct<protocolSection:struct<identificationModule:struct<nctId:string,briefTitle:string>,descriptionModule:struct<briefSummary:string>,
      statusModule:struct<overallStatus:string>,conditionsModule:struct<conditions:array<string>>,designModule:struct<phases:array<string>>>>>"""
    s = payloads.select(F.explode(F.from_json(column, schema)["studies"]["protocolSection"]).alias("p"))
    n, cond = F.col("p.identificationModule.nctId"), F.col("p.conditionsModule.conditions")
    return raw(
        s, source=F.lit("clinicaltrials"), source_id=n, url=F.concat(F.lit("https://clinicaltrials.gov/study/"), n), title=F.col("p.identificationModule.briefTitle"), abstract=F.col("p.descriptionModule.briefSummary"),
        document_type=F.lit("clinical_trial"), keywords=cond, metadata=_meta(nct_id=n, phase=F.array_join("p.designModule.phases", ","), status=F.col("p.statusModule.overallStatus")),
    )


def adverse_events(payloads: DataFrame, column: str = "json", drug: str = "drug") -> DataFrame:
    """S15d: one summary sentence per drug class from term counts; no terms give no row."""
    r = payloads.select(F.col(drug).alias("drug"), F.from_json(column, "results array<struct<term:string>>")["results"]["term"].alias("terms")).where(F.size("terms") > 0)
    top = F.slice("terms", 1, 10)
    return raw(
        r, source=F.lit("openfda"), source_id=F.concat(F.lit("fda_adverse_"), "drug"), url=F.concat(F.lit("https://api.fda.gov/drug/event.json?search="), "drug"), title=F.concat(F.lit("Adverse event profile: "), "drug"),
        abstract=F.concat(F.lit("Top adverse reactions for "), "drug", F.lit(": "), F.array_join(top, ", "), F.lit(". Total unique reaction types: "), F.size("terms").cast("string"), F.lit(".")),
        document_type=F.lit("adverse_event_summary"), keywords=top, metadata=_meta(drug_class=F.col("drug"), reaction_count=F.size("terms")),
    )


def target_diseases(payloads: DataFrame, column: str = "json", disease_id: str = "efo_id") -> DataFrame:
    """S15e: disease records; missing drug counts are 0."""
    schema = "data struct<disease:struct<name:string,description:string,knownDrugs:struct<count:long,uniqueTargets:long>,therapeuticAreas:array<struct<name:string>>>>"
    d = payloads.select(F.col(disease_id).alias("k"), F.from_json(column, schema)["data"]["disease"].alias("d")).where("d IS NOT NULL")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    areas = F.coalesce(F.col("d.therapeuticAreas.name"), F.array().cast("array<string>"))
    return raw(
        d, source=F.lit("opentargets"), source_id=F.col("k"), url=F.concat(F.lit("https://platform.opentargets.org/disease/"), "k"), title=F.concat(F.lit("Open Targets: "), F.coalesce("d.name", "k")),
        abstract=F.concat(F.coalesce("d.description", F.lit("")), F.lit(" Known drugs: "), zero("d.knownDrugs.count"), F.lit(", unique targets: "), zero("d.knownDrugs.uniqueTargets"), F.lit(", therapeutic areas: "), F.array_join(areas, ", "), F.lit(".")),
        document_type=F.lit("drug_target_association"), keywords=areas, metadata=_meta(efo_id=F.col("k"), known_drugs_count=zero("d.knownDrugs.count"), unique_targets=zero("d.knownDrugs.uniqueTargets")),
    )


def pathways(payloads: DataFrame, column: str = "flat", pathway_id: str = "kegg_id") -> DataFrame:
    """S15f: flat-file entries: the first NAME line, the text cut to 3000 characters."""
    name = F.trim(F.regexp_replace(F.regexp_extract(column, r"(?m)^(NAME.*)$", 1), "NAME", ""))
    k = F.col(pathway_id)
    return raw(
        payloads, source=F.lit("kegg"), source_id=k, url=F.concat(F.lit("https://www.kegg.jp/pathway/"), k), title=F.concat(F.lit("KEGG Pathway: "), F.coalesce(F.nullif(name, F.lit("")), k)),
        abstract=F.substring(column, 1, 3000), full_text=F.col(column), document_type=F.lit("disease_pathway"), metadata=_meta(kegg_id=k),
    )


def proteins(payloads: DataFrame, column: str = "json") -> DataFrame:
    """S15g: protein entries: genes, first function (500 characters), first five diseases."""
    schema = """results array<struct<primaryAccession:string,proteinDescription:struct<recommendedName:struct<fullName:struct<value:string>>>,genes:array<struct<geneName:struct<value:string>>>,
      comments:array<struct<commentType:string,texts:array<struct<value:string>>,disease:struct<diseaseId:string,description:string>>>>>"""
    p = payloads.select(F.explode(F.from_json(column, schema)["results"]).alias("e"))
    none = F.array().cast("array<string>")
    p = p.select(
        F.col("e.primaryAccession").alias("acc"), F.coalesce("e.proteinDescription.recommendedName.fullName.value", F.lit("")).alias("name"),
        F.coalesce(F.filter("e.genes.geneName.value", lambda g: g.isNotNull() & (g != "")), none).alias("genes"),
        F.coalesce(F.flatten(F.transform(F.filter("e.comments", lambda c: c["commentType"] == "FUNCTION"), lambda c: c["texts"]["value"])), none).alias("functions"),
        F.coalesce(F.transform(F.filter("e.comments", lambda c: (c["commentType"] == "DISEASE") & c["disease"].isNotNull()), lambda c: F.concat(F.coalesce(c["disease"]["diseaseId"], F.lit("")), F.lit(": "), F.coalesce(c["disease"]["description"], F.lit("")))), none).alias("diseases"),
    )
    listed = F.array_join("genes", ", ")
    abstract = F.concat(
        F.lit("Protein: "), "name", F.lit(". Genes: "), listed, F.lit(". "), F.when(F.size("functions") > 0, F.concat(F.lit("Function: "), F.substring(F.get("functions", 0), 1, 500), F.lit(". "))).otherwise(""),
        F.when(F.size("diseases") > 0, F.concat(F.lit("Associated diseases: "), F.array_join(F.slice("diseases", 1, 5), "; "), F.lit("."))).otherwise(""),
    )
    return raw(
        p, source=F.lit("uniprot"), source_id=F.col("acc"), url=F.concat(F.lit("https://www.uniprot.org/uniprot/"), "acc"), title=F.concat(F.lit("UniProt: "), "name", F.lit(" ("), listed, F.lit(")")),
        abstract=abstract, document_type=F.lit("protein_target"), keywords=F.concat("genes", F.array("name")), metadata=_meta(accession=F.col("acc")),
    )


def compounds(searches: DataFrame, details: DataFrame) -> DataFrame:
    """S15h: searches (query, json of ids) joined to detail payloads (cid, json); the first five ids of a search.

    Payloads are far larger than their estimate, so the join is a merge join by hint and descriptions are cut before it.
    """
    ids = searches.select("query", F.explode(F.slice(F.from_json("json", "IdentifierList struct<CID:array<long>>")["IdentifierList"]["CID"], 1, 5)).alias("cid"))
    d = details.select("cid", F.get(F.from_json("json", "InformationList struct<Information:array<struct<Title:string,Description:string>>>")["InformationList"]["Information"], F.lit(0)).alias("i"))
    d = d.select("cid", F.col("i.Title").alias("name"), F.substring("i.Description", 1, 2000).alias("description"))
    j = ids.join(d.hint("merge"), "cid", "left").withColumn("c", F.col("cid").cast("string"))
    return raw(
        j, source=F.lit("pubchem"), source_id=F.col("c"), url=F.concat(F.lit("https://pubchem.ncbi.nlm.nih.gov/compound/"), "c"), title=F.concat(F.lit("PubChem: "), F.coalesce("name", F.concat(F.lit("CID:"), "c"))),
        abstract=F.coalesce("description", F.lit("")), document_type=F.lit("compound"), metadata=_meta(cid=F.col("c"), search_query=F.col("query")),
    )


def preprints(pages: DataFrame, quota: int, column: str = "json", server: str = "server", page: str = "page") -> DataFrame:
    """Pages of preprint servers (server, page number, json) as documents: of each server, in order of pages and of
    articles in a page, the first quota / (number of servers, two) articles that mark an open question."""
    schema = "collection array<struct<doi:string,title:string,abstract:string,authors:string,date:string,type:string,version:string,category:string>>"
    a = pages.select(F.col(server).alias("server"), F.col(page).alias("page"), F.posexplode(F.from_json(column, schema)["collection"]).alias("nth", "a"))
    said = F.concat_ws(" ", "a.title", "a.abstract")
    a = a.where(contains_any(said, OPEN_QUESTION_SIGNALS))
    order = Window.partitionBy("server").orderBy("page", "nth")
    a = a.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= quota // 2)  # a top-k, cut before the shuffle
    doi = F.coalesce("a.doi", F.lit(""))
    return raw(
        a, source=F.col("server"), source_id=doi, url=F.when(doi != "", F.concat(F.lit("https://doi.org/"), doi)).otherwise(""), title=F.col("a.title"), abstract=F.col("a.abstract"), publication_date=F.col("a.date"),
        document_type=F.coalesce("a.type", F.lit("preprint")), authors=F.when(F.coalesce("a.authors", F.lit("")) != "", F.split("a.authors", "; ")), keywords=F.array(F.coalesce("a.category", F.lit(""))), metadata=_meta(doi=doi, version=F.coalesce("a.version", F.lit(""))),
    )


def genes(payloads: DataFrame, column: str = "json") -> DataFrame:
    """S15i: gene records with an id."""
    g = payloads.select(F.explode(F.from_json(column, "genes array<struct<gene:struct<gene_id:string,symbol:string,description:string,full_name:string>>>")["genes"]["gene"]).alias("g")).where("coalesce(g.gene_id, '') <> ''")
    return raw(
        g, source=F.lit("ncbi_datasets"), source_id=F.col("g.gene_id"), url=F.concat(F.lit("https://www.ncbi.nlm.nih.gov/gene/"), "g.gene_id"), title=F.concat(F.lit("NCBI Gene: "), "g.symbol", F.lit(" — "), "g.full_name"),
        abstract=F.concat(F.lit("Gene "), "g.symbol", F.lit(" ("), "g.full_name", F.lit("): "), "g.description"), document_type=F.lit("gene_record"), keywords=F.array("g.symbol", "g.full_name"), metadata=_meta(gene_id=F.col("g.gene_id")),
    )


def forum_questions(payloads: DataFrame, column: str = "json", site: str = "site") -> DataFrame:
    """S15j: forum questions; the HTML body as text, cut to 2000 characters."""
    q = payloads.select(F.col(site).alias("site"), F.explode(F.from_json(column, "items array<struct<question_id:string,title:string,body:string,link:string,tags:array<string>,score:long,view_count:long,answer_count:long>>")["items"]).alias("q"))
    return raw(
        q, source=F.concat(F.lit("stackexchange/"), "site"), source_id=F.col("q.question_id"), url=F.col("q.link"), title=F.col("q.title"), abstract=F.substring(strip_tags(F.col("q.body")), 1, 2000), document_type=F.lit("forum_question"),
        keywords=F.col("q.tags"), metadata=_meta(score=F.coalesce("q.score", F.lit(0)), view_count=F.coalesce("q.view_count", F.lit(0)), answer_count=F.coalesce("q.answer_count", F.lit(0))),
    )


def encyclopedia_pages(payloads: DataFrame, column: str = "json") -> DataFrame:
    """S15j: encyclopedia extracts; the page -1 means not found."""
    p = payloads.select(F.explode(F.from_json(column, "query struct<pages:map<string,struct<title:string,extract:string>>>")["query"]["pages"]).alias("id", "p")).where("id <> '-1'")
    return raw(
        p, source=F.lit("wikipedia"), source_id=F.concat(F.lit("wiki:"), "id"), url=F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.replace("p.title", F.lit(" "), F.lit("_"))), title=F.col("p.title"),
        abstract=F.substring("p.extract", 1, 3000), full_text=F.col("p.extract"), document_type=F.lit("encyclopedia"), metadata=_meta(page_id=F.col("id")),
    )


def list_questions(pages: DataFrame, id_col: str, html: str, *, least: int = 25, ending: str = "?") -> DataFrame:
    """Ranked list items that end with a question mark and are longer than `least`: id, rank, question, in_top_10."""
    items = F.transform(F.regexp_extract_all(html, F.lit(r"(?s)<li[^>]*>(.*?)</li>"), 1), strip_tags)
    kept = F.filter(items, lambda t: t.endswith(ending) & (F.length(t) > least))
    rows = pages.select(id_col, F.posexplode(kept).alias("p", "question"))
    return rows.select(id_col, (F.col("p") + 1).alias("rank"), "question", (F.col("p") < 10).alias("in_top_10"))


def table_records(pages: DataFrame, id_col: str, html: str) -> DataFrame:
    """Rows of three cells or more whose second is a record id and third a name of 30 characters: the first of each id in a page."""
    rows = pages.select(id_col, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), 1)).alias("p", "row"))
    cells = F.transform(F.regexp_extract_all("row", F.lit(r"(?s)<t[dh][^>]*>(.*?)</t[dh]>"), 1), strip_tags)
    good = rows.withColumn("c", cells).where(F.size("c") >= 3).select(id_col, "p", F.col("c")[1].alias("record_id"), F.col("c")[2].alias("name"), F.regexp_extract("row", r'href="([^"]+research-recommendations/[^"]+)"', 1).alias("href"))
    good = good.where(F.col("record_id").rlike(r"^[A-Z]{2,4}\d{1,4}(?:/\d{1,3})?$") & (F.length("name") >= 30))
    first = good.groupBy(id_col, "record_id").agg(F.min_by(F.struct("name", "href"), "p").alias("r"))
    return first.select(id_col, "record_id", "r.name", "r.href")


def main_content(html: Column) -> tuple[Column, Column]:
    """(title, text) of a page: main, else article, else body; scripts and styles go, tags part lines."""
    part = lambda tag: F.nullif(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*)</{tag}>", 1), F.lit(""))
    body = F.coalesce(part("main"), part("article"), part("body"), html)
    body = F.regexp_replace(body, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ")
    title = F.coalesce(F.nullif(strip_tags(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit("")), F.lit("Document"))
    return title, strip_tags(body)


def choice_items(frames: dict[str, DataFrame]) -> DataFrame:
    """Three question sets in one layout: id, dataset, prompt, choices, answer, answer_text.

    lettered: (i, question, options map, answer_idx); verdict: (i, question, contexts, final_decision); indexed: (i, question, a, b, c, d, cop).
    """
    letters = F.lit(["A", "B", "C", "D", "E"])
    out = []
    if "lettered" in frames:
        d = frames["lettered"]
        out.append(d.select(F.concat(F.lit("lettered-"), "i").alias("id"), F.lit("lettered").alias("dataset"), F.col("question").alias("prompt"), F.transform(F.filter(letters, lambda x: F.map_contains_key("options", x)), lambda x: F.element_at("options", x)).alias("choices"), F.col("answer_idx").alias("answer"), F.element_at("options", F.col("answer_idx")).alias("answer_text")))
    if "verdict" in frames:
        d = frames["verdict"]
        code = F.when(F.col("final_decision") == "yes", "A").when(F.col("final_decision") == "no", "B").when(F.col("final_decision") == "maybe", "C")
        prompt = F.concat(F.lit("Context: "), F.array_join("contexts", " "), F.lit("\n\nQuestion: "), "question")
        out.append(d.select(F.concat(F.lit("verdict-"), "i").alias("id"), F.lit("verdict").alias("dataset"), prompt.alias("prompt"), F.lit(["yes", "no", "maybe"]).alias("choices"), code.alias("answer"), F.col("final_decision").alias("answer_text")))
    if "indexed" in frames:
        d = frames["indexed"]
        choices = F.array("a", "b", "c", "d")
        out.append(d.select(F.concat(F.lit("indexed-"), "i").alias("id"), F.lit("indexed").alias("dataset"), F.col("question").alias("prompt"), choices.alias("choices"), F.get(letters, F.col("cop")).alias("answer"), F.get(choices, F.col("cop")).alias("answer_text")))
    got = out[0]
    for o in out[1:]:
        got = got.unionByName(o)
    return got


# -- paged fetching -----------------------------------------------------------------------------------------
class PagedSource(DataSource):
    """Rows (query, page, payload) of a paged service.

    Options: `fetch`, a dotted name of a function (query, cursor) -> (payload, next cursor or None), importable on
    executors; `queries`, a JSON list. One partition per query, so a failed query is retried alone; paging stops on an
    empty payload or a cursor seen before.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "query string, page int, payload string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options["fetch"], json.loads(self.options["queries"]))


class PagedReader(DataSourceReader):
    def __init__(self, fetch: str, queries: list[str]):
        self.fetch, self.queries = fetch, queries

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(q) for q in self.queries]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import importlib

        module, _, name = self.fetch.rpartition(".")
        fetch: Callable = getattr(importlib.import_module(module), name)
        cursor, seen, page = None, set(), 0
        while True:
            payload, after = fetch(partition.value, cursor)
            if not payload:
                return
            yield partition.value, page, payload
            page += 1
            if after is None or after in seen:
                return
            seen.add(after)
            cursor = after


def read_pages(spark: SparkSession, fetch: str, queries: list[str], done: DataFrame | None = None) -> DataFrame:
    """Pages of all queries not yet in `done` (a frame with a query column), for resumed crawls."""
    if done is not None:
        todo = spark.createDataFrame([(q,) for q in queries], "query string").join(done.select("query").distinct(), "query", "left_anti")
        queries = [r.query for r in todo.collect()]  # a list of queries, held by the driver anyway
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged").option("fetch", fetch).option("queries", json.dumps(queries)).load()
