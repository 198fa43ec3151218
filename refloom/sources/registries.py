"""Records of registries, as JSON responses, to items.  Crossref's are in readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers as I
from ..functions import text as X
from ..schema import NAME, as_items
from .readers import _date, inverted_abstract

# Types of the registries in terms of items.
DATACITE_TYPES = {"Dataset": "dataset", "Software": "software", "Text": "report", "Report": "report", "Dissertation": "thesis", "Book": "book", "BookChapter": "chapter", "ConferencePaper": "paper-conference", "ConferenceProceeding": "paper-conference", "JournalArticle": "article-journal", "Preprint": "article", "Standard": "standard", "Collection": "collection", "Image": "graphic", "Audiovisual": "motion_picture", "Sound": "song", "InteractiveResource": "software", "Model": "dataset", "Workflow": "software", "OutputManagementPlan": "report", "PeerReview": "review", "Other": "document", "ComputationalNotebook": "software"}
OPENALEX_TYPES = {"journal-article": "article-journal", "article": "article-journal", "book-chapter": "chapter", "book": "book", "proceedings-article": "paper-conference", "proceedings": "paper-conference", "dissertation": "thesis", "dataset": "dataset", "report": "report", "standard": "standard", "preprint": "article", "posted-content": "article", "review": "review", "editorial": "article-journal", "letter": "article-journal", "peer-review": "review", "paratext": "document", "grant": "report", "other": "document"}

DATACITE = "struct<data:struct<attributes:struct<doi:string,url:string,titles:array<struct<title:string>>,creators:array<struct<name:string,familyName:string,givenName:string,nameType:string>>,publisher:string,version:string,publicationYear:string,descriptions:array<struct<description:string>>,types:struct<resourceTypeGeneral:string,resourceType:string>,container:struct<title:string,volume:string,issue:string,firstPage:string,lastPage:string>>>>"
PUBMED = "struct<title:string,authors:array<struct<name:string>>,sortpubdate:string,pubdate:string,fulljournalname:string,source:string,volume:string,issue:string,pages:string,elocationid:string,articleids:array<struct<idtype:string,value:string>>>"
OPENALEX = "struct<id:string,doi:string,ids:struct<doi:string,pmid:string>,type:string,title:string,display_name:string,authorships:array<struct<author:struct<display_name:string>>>,publication_year:string,abstract_inverted_index:map<string,array<int>>,primary_location:struct<landing_page_url:string,source:struct<display_name:string,issn_l:string,host_organization_name:string>>,open_access:struct<oa_url:string>,host_venue:struct<publisher:string>,biblio:struct<volume:string,issue:string,first_page:string,last_page:string>>"
OPENLIBRARY = "map<string,struct<title:string,authors:array<struct<name:string>>,publish_date:string,publishers:array<struct<name:string>>>>"


def _person(family: Column | None = None, given: Column | None = None, literal: Column | None = None) -> Column:
    own = {"family": family, "given": given, "literal": literal}
    names = [f.split(":")[0] for f in NAME[len("struct<") : -1].split(",")]
    return F.struct(*[(own[n] if own.get(n) is not None else F.lit(None).cast("string")).alias(n) for n in names])


def _full(c: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(c, F.lit(""))


def _types(kinds: dict[str, str], c: Column, other: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.coalesce(c, F.lit(""))), F.lit(other))


def _pages(first: Column, last: Column) -> Column:
    return F.when(_full(first).isNotNull(), F.concat_ws("-", _full(first), _full(last)))


def _family_last(name: Column, one_word_is_literal: bool) -> Column:
    """The last word is the family name, what is before it the given one."""
    words = F.split(name, " ")
    person = _person(F.element_at(words, -1), F.array_join(F.slice(words, 1, F.size(words) - 1), " "))
    return F.when(F.size(words) < 2, _person(literal=name)).otherwise(person) if one_word_is_literal else person


def from_datacite(responses: DataFrame, body: str = "body") -> DataFrame:
    """responses: body (a DOI's record).  Items; records without a DOI or that aren't JSON are left out."""
    a = responses.select(F.from_json(body, DATACITE)["data"]["attributes"].alias("a")).filter("a.doi IS NOT NULL")
    general, own = F.col("a.types.resourceTypeGeneral"), F.col("a.types.resourceType")
    kind = F.when(own.rlike(r"(?i)\bpre-?print\b"), "article").otherwise(_types(DATACITE_TYPES, general, "document"))
    creator = lambda c: F.when((c["nameType"] == "Organizational") | (_full(c["familyName"]).isNull() & _full(c["name"]).isNotNull()), _person(literal=c["name"])).otherwise(_person(c["familyName"], c["givenName"]))
    box = F.col("a.container")
    return as_items(
        a.select(
            F.concat(F.lit("datacite-"), F.regexp_replace("a.doi", "[^a-zA-Z0-9]", "-")).alias("id"), kind.alias("type"), F.get("a.titles", 0)["title"].alias("title"), F.transform("a.creators", creator).alias("author"), F.col("a.doi").alias("DOI"), F.col("a.url").alias("URL"),
            F.coalesce(F.get_json_object("a.publisher", "$.name"), F.col("a.publisher")).alias("publisher"), "a.version", F.get("a.descriptions", 0)["description"].alias("abstract"), _date(F.col("a.publicationYear")).alias("issued"), _full(own).alias("genre"),
            _full(box["title"]).alias("container_title"), _full(box["volume"]).alias("volume"), _full(box["issue"]).alias("issue"), _pages(box["firstPage"], box["lastPage"]).alias("page"), F.lit("doi").alias("source_format"), F.lit(1.0).alias("parse_confidence"),
        )
    )


def from_pubmed(responses: DataFrame, pmid: str = "pmid", body: str = "body") -> DataFrame:
    """responses: pmid, body (a summary response).  Items; pmids without a title in the response are left out."""
    digits = F.regexp_replace(pmid, r"\D", "")
    record = F.call_function("get_json_object", F.col(body), F.concat(F.lit("$.result."), digits))
    r = responses.select(digits.alias("pmid"), F.from_json(record, PUBMED).alias("r")).filter("r.title != ''")
    words = lambda a: F.split(a["name"], " ")
    person = lambda a: _person(F.get(words(a), 0), F.array_join(F.slice(words(a), 2, F.greatest(F.size(words(a)) - 1, F.lit(0))), " "))
    known = lambda kind: _full(F.get(F.filter("r.articleids", lambda x: x["idtype"] == kind), 0)["value"])
    year = lambda c: _full(F.regexp_extract(c, r"^(\d{4})", 1))
    full = lambda c: _full(F.col(f"r.{c}"))
    return as_items(
        r.select(
            F.concat(F.lit("pmid-"), "pmid").alias("id"), F.lit("article-journal").alias("type"), "r.title", F.transform("r.authors", person).alias("author"), F.coalesce(full("fulljournalname"), full("source")).alias("container_title"), full("volume").alias("volume"), full("issue").alias("issue"), full("pages").alias("page"),
            F.coalesce(known("doi"), I.doi(F.col("r.elocationid"))).alias("DOI"), F.col("pmid").alias("PMID"), known("pmc").alias("PMCID"), _date(F.coalesce(year("r.sortpubdate"), year("r.pubdate"))).alias("issued"), F.lit("pmid").alias("source_format"), F.lit(1.0).alias("parse_confidence"),
        )
    )


def from_openalex(responses: DataFrame, body: str = "body") -> DataFrame:
    """responses: body (one work).  Items; what isn't JSON is left out."""
    w = responses.select(F.from_json(body, OPENALEX).alias("w")).filter("w.id IS NOT NULL OR w.doi IS NOT NULL")
    at = F.col("w.primary_location")
    doi = F.regexp_replace(F.coalesce("w.doi", "w.ids.doi", F.lit("")), r"(?i)^https?://doi\.org/", "")
    name = F.coalesce(F.regexp_replace("w.id", r"^https?://openalex\.org/", ""), F.regexp_replace(doi, "[^a-zA-Z0-9]", "-"))
    return as_items(
        w.select(
            F.concat(F.lit("openalex-"), name).alias("id"), _types(OPENALEX_TYPES, F.col("w.type"), "article-journal").alias("type"), F.coalesce("w.title", "w.display_name").alias("title"), F.transform("w.authorships", lambda a: _family_last(F.coalesce(a["author"]["display_name"], F.lit("")), True)).alias("author"), _full(doi).alias("DOI"),
            _date(F.col("w.publication_year")).alias("issued"), inverted_abstract(F.col("w.abstract_inverted_index")).alias("abstract"), at["source"]["display_name"].alias("container_title"), _full(at["source"]["issn_l"]).alias("ISSN"), F.coalesce(_full(at["landing_page_url"]), _full(F.col("w.open_access.oa_url"))).alias("URL"),
            F.coalesce(_full(F.col("w.host_venue.publisher")), _full(at["source"]["host_organization_name"])).alias("publisher"), _full(F.col("w.biblio.volume")).alias("volume"), _full(F.col("w.biblio.issue")).alias("issue"), _pages(F.col("w.biblio.first_page"), F.col("w.biblio.last_page")).alias("page"),
            _full(F.regexp_replace("w.ids.pmid", r"^https?://pubmed\.ncbi\.nlm\.nih\.gov/", "")).alias("PMID"), F.lit("doi").alias("source_format"), F.lit(0.9).alias("parse_confidence"),
        )
    )


def from_openlibrary(responses: DataFrame, isbn: str = "isbn", body: str = "body") -> DataFrame:
    """responses: isbn, body.  Items; an ISBN that the response doesn't hold is left out."""
    book = F.try_element_at(F.from_json(body, OPENLIBRARY), F.concat(F.lit("ISBN:"), isbn))
    b = responses.select(F.col(isbn).alias("isbn"), book.alias("b")).filter("b IS NOT NULL")
    year = _full(F.regexp_extract("b.publish_date", r"(\d{4})", 1))
    return as_items(b.select(F.concat(F.lit("isbn-"), "isbn").alias("id"), F.lit("book").alias("type"), "b.title", F.transform("b.authors", lambda a: _family_last(a["name"], False)).alias("author"), F.get("b.publishers", 0)["name"].alias("publisher"), F.col("isbn").alias("ISBN"), _date(year).alias("issued"), F.lit("isbn").alias("source_format"), F.lit(1.0).alias("parse_confidence")))


META = r"(?i)<meta\s+(?:name|property)=[\"'][^\"']+[\"']\s+content=[\"'][^\"']*[\"']"
META_TURNED = r"(?i)<meta\s+content=[\"'][^\"']*[\"']\s+(?:name|property)=[\"'][^\"']+[\"']"


def meta_tags(html: Column) -> Column:
    """array of (name, content) of meta tags, either attribute first; of repeated names the last counts."""
    one = lambda t: F.struct(F.lower(F.regexp_extract(t, r"(?i)(?:name|property)=[\"']([^\"']+)", 1)).alias("name"), F.regexp_extract(t, r"(?i)\scontent=[\"']([^\"']*)", 1).alias("content"))
    return F.transform(F.concat(F.regexp_extract_all(html, F.lit(META), 0), F.regexp_extract_all(html, F.lit(META_TURNED), 0)), one)


def from_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages: url, html.  Items from the meta tags of pages; a page without any has its title only.  Null html: no item."""
    d = pages.filter(F.col(html).isNotNull()).select(F.col(url).alias("url"), meta_tags(F.col(html)).alias("m"), F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1).alias("head"))
    every = lambda name: F.transform(F.filter("m", lambda e: e["name"] == name), lambda e: F.trim(e["content"]))
    last = lambda name: F.get(F.reverse(F.filter("m", lambda e: e["name"] == name)), 0)["content"]
    first = lambda *names: _full(F.coalesce(*map(last, names)))
    names = F.filter(F.concat(*map(every, ("citation_author", "dc.creator", "author", "article:author"))), lambda n: n != "")
    once = F.filter(names, lambda n, i: F.array_position(F.transform(names, F.lower), F.lower(n)) == i + 1)
    halves = lambda n: F.split(n, r",\s*")
    person = lambda n: F.when((F.size(halves(n)) == 2) & (F.char_length(F.get(halves(n), 0)) > 1) & (F.get(halves(n), 1) != ""), _person(F.get(halves(n), 0), F.get(halves(n), 1))).otherwise(_family_last(F.regexp_replace(n, r"\s+", " "), True))
    site = first("og:site_name", "application-name", "publisher", "dc.publisher", "citation_journal_title")
    date = F.coalesce(*map(last, ("citation_publication_date", "citation_date", "article:published_time", "date", "dc.date")))
    return as_items(
        d.select(
            F.col("url").alias("id"), F.when(first("citation_journal_title").isNotNull(), "article-journal").otherwise("webpage").alias("type"), F.coalesce(first("citation_title", "dc.title", "og:title"), _full(X.collapse(F.col("head")))).alias("title"), F.when(F.size(once) > 0, F.transform(once, person)).alias("author"),
            F.coalesce(first("citation_journal_title"), site).alias("container_title"), first("description", "og:description", "dc.description").alias("abstract"), I.doi(F.coalesce(last("citation_doi"), last("dc.identifier"))).alias("DOI"), first("citation_volume").alias("volume"), first("citation_issue").alias("issue"),
            _pages(last("citation_firstpage"), last("citation_lastpage")).alias("page"), _date(_full(F.regexp_extract(date, r"(\d{4})", 1))).alias("issued"), F.col("url").alias("URL"), F.lit("url").alias("source_format"),
        )
    )
