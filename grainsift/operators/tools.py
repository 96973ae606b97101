"""Tool results: what each retrieval tool hands on of a service's payload, as one declarative table of projections.

A payload is a JSON text. A projection names the schema to read, the array of records in it and the fields kept of each;
all of it is evaluated in the JVM, for many calls at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainsift.functions import text as X

MAX_RESULT = 12_000  # characters of a serialised result
TOO_LONG = "result truncated; partial text only"


@dataclass(frozen=True)
class Projection:
    """schema of the payload, path of the record array, fields (name -> column of a record), records kept (None: as asked)."""

    schema: str
    records: str
    fields: dict[str, Callable[[Column], Column]]
    most: int | None = None


def _text(path: str) -> Callable[[Column], Column]:
    """A field below nested records, empty where any level is missing."""
    return lambda r: F.coalesce(_at(r, path), F.lit(""))


def _at(r: Column, path: str) -> Column:
    for k in path.split("."):
        r = r[k]
    return r


def _texts(path: str, field: str | None = None) -> Callable[[Column], Column]:
    return lambda r: F.coalesce(F.transform(_at(r, path), lambda x: F.coalesce(_at(x, field) if field else x, F.lit(""))), F.array().cast("array<string>"))


# Names of the tools, paths in the services' payloads, names and limits of the fields handed on.
PROJECTIONS = {
    "pubmed": Projection(
        "resultList struct<result:array<struct<pmid:string,id:string,title:string,abstractText:string>>>", "resultList.result",
        {"pmid": lambda r: F.coalesce(F.nullif(r["pmid"], F.lit("")), r["id"], F.lit("")), "title": _text("title"), "abstract": lambda r: F.left(F.coalesce(r["abstractText"], F.lit("")), F.lit(1000))},
    ),
    "clinicaltrialsgov": Projection(
        """studies array<struct<protocolSection:struct<identificationModule:struct<nctId:string,briefTitle:string>,statusModule:struct<overallStatus:string>,
          conditionsModule:struct<conditions:array<string>>,armsInterventionsModule:struct<interventions:array<struct<name:string>>>>>>""", "studies",
        {
            "nct_id": _text("protocolSection.identificationModule.nctId"), "title": _text("protocolSection.identificationModule.briefTitle"),
            "status": _text("protocolSection.statusModule.overallStatus"), "conditions": _texts("protocolSection.conditionsModule.conditions"),
            "interventions": _texts("protocolSection.armsInterventionsModule.interventions", "name"),
        },
    ),
    "uniprot": Projection(
        """results array<struct<primaryAccession:string,uniProtkbId:string,proteinDescription:struct<recommendedName:struct<fullName:struct<value:string>>>,
          genes:array<struct<geneName:struct<value:string>>>,organism:struct<scientificName:string>,sequence:struct<length:long>>>""", "results",
        {
            "accession": _text("primaryAccession"), "id": _text("uniProtkbId"), "protein_name": _text("proteinDescription.recommendedName.fullName.value"),
            "gene_names": _texts("genes", "geneName.value"), "organism": _text("organism.scientificName"), "length": lambda r: F.coalesce(r["sequence"]["length"], F.lit(0)),
        },
    ),
    "ncbi_datasets:gene": Projection(
        "genes array<struct<gene:struct<gene_id:string,symbol:string,description:string,type:string,chromosomes:array<string>>>>", "genes",
        {k: _text(f"gene.{k}") for k in ("gene_id", "symbol", "description", "type")} | {"chromosomes": _texts("gene.chromosomes")}, 5,
    ),
    "ncbi_datasets:genome": Projection(
        "reports array<struct<accession:string,organism:struct<organism_name:string>,assembly_info:struct<assembly_level:string,assembly_name:string>>>", "reports",
        {"accession": _text("accession"), "organism": _text("organism.organism_name"), "assembly_level": _text("assembly_info.assembly_level"), "assembly_name": _text("assembly_info.assembly_name")}, 5,
    ),
}
# Tools that hand on a part of the payload as it is, by its JSON path; an empty list or object where it is missing.
PARTS = {"openfda": ("$.results", "[]"), "opentargets": ("$.data", "{}"), "pubchem": ("$.PropertyTable.Properties", "[]"), "chembl:get": ("$", "{}")}


def _projected(p: Projection, payload: Column, asked: Column | int) -> Column:
    some = F.slice(_at(F.from_json(payload, p.schema), p.records), F.lit(1), F.lit(p.most) if p.most else F.greatest(F.lit(0), asked if isinstance(asked, Column) else F.lit(asked)))
    rows = F.transform(some, lambda r: F.struct(*[f(r).alias(n) for n, f in p.fields.items()]))
    return F.coalesce(F.to_json(rows), F.lit("[]"))


def _lines(payload: Column) -> Column:
    """Lines with a tab as objects of their first two fields, others as they are."""
    lines = F.filter(F.split(F.left(F.regexp_replace(payload, r"^\s+|\s+$", ""), F.lit(MAX_RESULT)), "\n"), lambda w: F.trim(w) != "")

    def parsed(w: Column) -> Column:
        fields = F.split(w, "\t")
        several = F.size(fields) > 1
        return F.struct(F.when(several, F.get(fields, 0)).alias("id"), F.when(several, F.get(fields, 1)).alias("description"), F.when(~several, w).alias("raw"))

    return F.to_json(F.transform(lines, parsed))


def result_of(tool: Column, operation: Column, payload: Column, *, asked: Column | int = 5) -> Column:
    """The result of one call as JSON text: by the tool's projection, part or line form; an error object for an unknown tool.

    Hyphens in names count as underscores; `asked` records are kept where the tool has no number of its own. operation tells
    the forms of a tool apart: gene or genome (ncbi_datasets), find, get or link (kegg), get or the name of an endpoint
    (chembl); others ignore it. A biomcp payload holds two payloads, {"pubmed": .., "clinical_trials": ..}, three records of each.
    """
    name, form = X.tool_name(tool), F.coalesce(operation, F.lit(""))
    key = F.concat(name, F.lit(":"), form)
    error = lambda said, c: F.to_json(F.struct(F.concat(F.lit(said), c).alias("error")))
    part = lambda path, none: F.coalesce(F.get_json_object(payload, path), F.lit(none))
    both = [_projected(PROJECTIONS[t], F.get_json_object(payload, f"$.{k}"), 3) for k, t in (("pubmed", "pubmed"), ("clinical_trials", "clinicaltrialsgov"))]
    cases = [(key == k if ":" in k else name == k, _projected(p, payload, asked)) for k, p in PROJECTIONS.items()]
    cases += [(key == k if ":" in k else name == k, part(*v)) for k, v in PARTS.items()]
    cases += [
        (name == "ncbi_datasets", error("Unknown query_type: ", form)),
        (name == "chembl", F.coalesce(F.call_function("get_json_object", payload, F.concat(F.lit("$."), form, F.lit("s"))), payload)),
        (key == "kegg:get", F.to_json(F.struct(F.left(payload, F.lit(MAX_RESULT)).alias("entry")))),
        (key.isin("kegg:find", "kegg:link"), _lines(payload)),
        (name == "kegg", error("Unknown operation: ", form)),
        (name == "biomcp", F.concat(F.lit('{"pubmed":'), both[0], F.lit(',"clinical_trials":'), both[1], F.lit("}"))),
    ]
    out = error("Unknown tool: ", tool)
    for when, result in reversed(cases):
        out = F.when(when, result).otherwise(out)
    return out


def tool_results(calls: DataFrame, *, tool: str = "tool", operation: str = "operation", payload: str = "payload", asked: Column | int = 5) -> DataFrame:
    """calls plus result (JSON text) and truncated: results over MAX_RESULT characters become an object with the text cut there
    and a note. A null payload (a failed call) gives an error object."""
    full = F.when(F.col(payload).isNull(), F.lit('{"error":"Request failed"}')).otherwise(result_of(F.col(tool), F.col(operation), F.col(payload), asked=asked))
    long_ = F.length("_full") > MAX_RESULT
    cut = F.to_json(F.struct(F.left("_full", F.lit(MAX_RESULT)).alias("truncated_text"), F.lit(TOO_LONG).alias("note")))
    return calls.withColumn("_full", full).select(*calls.columns, F.when(long_, cut).otherwise(F.col("_full")).alias("result"), long_.alias("truncated"))
