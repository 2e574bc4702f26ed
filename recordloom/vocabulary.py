"""Namespaces and the mapping tables that drive extraction.

The own namespaces hang below a base address that the user passes in, so the tables hold only
local names.  Users extend extraction by adding rows, not code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from recordloom.catalog import LOWER, ANALYZED, INDEXES, ROLES

# Public vocabularies, by the short name used in the tables below.
PUBLIC_NAMESPACES = {
    "foaf": "http://xmlns.com/foaf/0.1/",
    "geo": "http://www.mindswap.org/2003/owl/geo/geoFeatures20040307.owl#",
    "terms": "http://purl.org/dc/terms/",
    "owl": "http://www.w3.org/2002/07/owl#",
    "cidoc": "http://www.cidoc-crm.org/rdfs/cidoc-crm#",
    "bio": "http://purl.org/vocab/bio/0.1/",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
}

# Record rule sets from oldest to newest; each keeps the rules of the ones before.
RULE_SETS = ("1.0", "1.1", "1.11", "1.2.0", "1.3.0")

# First rule set | node it hangs on (- is the entity) | predicate | index | marks.
# Marks: one = at most one value, raw = URIs are kept as they are.
_FIELDS = """
1.0 | - | serviceName | serviceName | one
1.0 | - | serviceOrganization | serviceOrganization | one
1.0 | - | itemTitle | itemTitle |
1.0 | - | itemLabel | itemLabel | one
1.0 | - | itemType | itemType | one
1.0 | - | itemClass | itemClass | raw
1.0 | - | itemClassName | itemClassName |
1.0 | - | itemName | itemName |
1.0 | itemName | name | itemName |
1.0 | - | itemSpecification | itemSpecification |
1.0 | itemSpecification | spec | itemSpecification |
1.0 | - | itemKeyWord | itemKeyWord |
1.0 | - | itemMotiveWord | itemMotiveWord |
1.0 | - | itemMaterial | itemMaterial |
1.0 | itemMaterial | material | itemMaterial |
1.0 | - | itemTechnique | itemTechnique |
1.0 | - | itemStyle | itemStyle |
1.0 | - | itemColor | itemColor |
1.0 | - | itemNumber | itemNumber |
1.0 | itemNumber | number | itemNumber |
1.0 | - | itemDescription | itemDescription |
1.0 | itemDescription | desc | itemDescription |
1.0 | - | itemLicense | itemLicense | one raw
1.0 | - | subject | subject |
1.0 | - | collection | collection |
1.0 | - | dataQuality | dataQuality | one
1.0 | - | mediaType | mediaType |
1.0 | - | theme | theme |
1.1 | - | itemSuperType | itemSuperType | one
1.1 | - | foaf:name | name |
1.1 | - | foaf:firstName | firstName | one
1.1 | - | foaf:surname | surname | one
1.1 | - | foaf:fullName | fullName | one
1.1 | - | foaf:gender | gender | one
1.1 | - | foaf:title | title | one
1.1 | - | foaf:organization | organization | one
1.2.0 | - | itemMark | itemMark |
1.2.0 | itemMark | form | itemMark |
1.2.0 | - | itemInscription | itemInscription |
1.2.0 | itemInscription | text | itemInscription |
1.0 | context | placeName | placeName |
1.0 | context | cadastralUnit | cadastralUnit | one
1.0 | context | continentName | continentName | one
1.0 | context | countryName | countryName |
1.0 | context | countyName | countyName | one
1.0 | context | municipalityName | municipalityName | one
1.0 | context | provinceName | provinceName | one
1.0 | context | parishName | parishName | one
1.0 | context | geo:country | country | one
1.0 | context | geo:county | county | one
1.0 | context | geo:municipality | municipality | one
1.0 | context | geo:province | province | one
1.0 | context | geo:parish | parish | one
1.0 | context | foaf:firstName | firstName | one
1.0 | context | foaf:surname | surname | one
1.0 | context | foaf:fullName | fullName | one
1.0 | context | foaf:name | name | one
1.0 | context | foaf:gender | gender | one
1.0 | context | foaf:organization | organization | one
1.0 | context | foaf:title | title | one
1.0 | context | fromTime | fromTime | one
1.0 | context | toTime | toTime | one
1.0 | context | fromPeriodName | fromPeriodName | one
1.0 | context | toPeriodName | toPeriodName | one
1.0 | context | eventName | eventName | one
1.0 | context | eventAuth | event | one
1.3.0 | context | fromPeriod | fromPeriod | raw
1.3.0 | context | toPeriod | toPeriod | raw
1.3.0 | context | event | event | raw
1.3.0 | context | placeTerm | placeTerm | raw
1.3.0 | context | agent | agent | raw
1.0 | image | mediaLicense | mediaLicense | raw
1.0 | image | mediaMotiveWord | mediaMotiveWord |
1.0 | image | thumbnailSource | thumbnailSource | raw
1.0 | image | lowresSource | lowresSource | raw
1.0 | image | highresSource | highresSource | raw
1.11 | image | mediaType | mediaType | raw
1.11 | image | byline | byline | raw
1.11 | image | copyright | copyright | raw
1.11 | media | mediaLicense | mediaLicense | raw
1.11 | media | mediaMotiveWord | mediaMotiveWord |
1.11 | media | mediaType | mediaType | raw
1.11 | media | byline | byline | raw
1.11 | media | copyright | copyright | raw
"""

# Relations of the entity, first rule set | predicates.
_ITEM_RELATIONS = """
1.0 | owl:sameAs isRelatedTo containsObject hasBeenUsedIn hasChild hasParent hasFind isFoundIn
1.0 | hasImage hasObjectExample hasPart isPartOf isDescribedBy isVisualizedBy visualizes
1.0 | containsInformationAbout
1.1 | isMentionedBy terms:replaces mentions isContainedIn isObjectExampleFor describes
1.1 | cidoc:P11B.participated_in cidoc:P11F.had_participant cidoc:P12B.was_present_at
1.1 | cidoc:P12F.occurred_in_the_presence_of cidoc:P107B.is_current_or_former_member_of
1.1 | cidoc:P107F.has_current_or_former_member bio:child bio:parent bio:mother bio:father
"""

# Relations inside a context beside the roles and their inverses.
_CONTEXT_RELATIONS = """
1.1 | cidoc:P49B.is_former_or_current_keeper_of cidoc:P49F.has_former_or_current_keeper
1.1 | cidoc:P51B.is_former_or_current_owner_of cidoc:P51F.has_former_or_current_owner
1.1 | cidoc:P94B.was_created_by cidoc:P94F.has_created
1.1 | cidoc:P105B.has_right_on cidoc:P105F.right_held_by marriedTo
1.3.0 | fromPeriod toPeriod event placeTerm agent
"""

# Fixed value: the one role that is not read from a context.
ROLE_NOT_READ = "composer"

# Ordered corrections of own resource addresses, below the base.
RESOURCE_FIXES = """
resurser/aut resurser/aukt
resurser/aukt/geo/continent/continent resurser/aukt/geo/continent
resurser/aukt/geo/country/country resurser/aukt/geo/country
resurser/aukt/geo/county/county resurser/aukt/geo/county
resurser/aukt/geo/municipality/municipality resurser/aukt/geo/municipality
resurser/aukt/geo/parish/parish resurser/aukt/geo/parish
resurser/aukt/geo/province/province resurser/aukt/geo/province
resurser/contextsupertype/contextsupertype resurser/contextsupertype
resurser/contexttyp/contexttype resurser/contexttype
resurser/contexttype/contexttype resurser/contexttype
resurser/dataquality/dataquality resurser/dataquality
resurser/entitysupertype/entitysupertype resurser/entitysupertype
resurser/entitytype/entitytype resurser/entitytype
resurser/license/license resurser/license
resurser/subject/subject resurser/subject
resurser/theme/theme resurser/theme
resurser/title/title resurser/title
"""

# Starts that stand for a vocabulary, and the vocabulary they become.
NAMESPACE_STARTS = (
    ("http://xmlns.com/foaf", "foaf"),
    ("http://www.mindswap.org/2003/owl/geo", "geo"),
    ("{own}", "own"),
    ("http://www.cidoc-crm.org/rdfs/cidoc-crm", "cidoc"),
    ("http://purl.org/vocab/bio/0.1", "bio"),
)

# Place, actor and time fields; they make up the free text groups.
PLACE_FIELDS = (
    "placeName cadastralUnit continentName countryName countyName municipalityName provinceName "
    "parishName country county municipality province parish placeTerm"
).split()
ACTOR_FIELDS = "firstName surname fullName name gender organization title agent".split()
TIME_FIELDS = "fromTime toTime fromPeriodName toPeriodName fromPeriod toPeriod eventName event".split()
CONTEXT_FIELDS = frozenset(PLACE_FIELDS + ACTOR_FIELDS + TIME_FIELDS)


@dataclass(frozen=True)
class Names:
    """Addresses of one aggregator: base, own vocabulary below it, and its version property."""

    base: str = "http://records.example.org/"
    vocabulary: str = "vocabulary#"
    version_property: str = "recordVersion"

    @property
    def own(self) -> str:
        return self.base + self.vocabulary

    def full(self, name: str) -> str:
        """Full URI of a table entry: ``short:local`` or a local name of the own vocabulary."""
        short, colon, local = name.partition(":")
        return PUBLIC_NAMESPACES[short] + local if colon else self.own + name

    def resource(self, path: str) -> str:
        return f"{self.base}resurser/{path}"

    @property
    def context_type(self) -> str:
        return self.resource("ContextType#")

    @property
    def context_supertype(self) -> str:
        return self.resource("ContextSuperType#")

    @property
    def own_periods(self) -> str:
        return self.resource("aukt/srdb/period#")

    def area(self, kind: str) -> str:
        return self.resource(f"aukt/geo/{kind}#")


def _lines(text: str) -> list[list[str]]:
    return [[part.strip() for part in line.split("|")] for line in text.strip().splitlines()]


def field_rules(spark: SparkSession, names: Names) -> DataFrame:
    """(since, via, predicate, index, lookup, single); ``since`` is a place in RULE_SETS."""
    rows = []
    for since, via, predicate, index, marks in _lines(_FIELDS):
        rows.append((
            RULE_SETS.index(since), "" if via == "-" else names.full(via), names.full(predicate),
            index, "raw" not in marks, "one" in marks,
        ))
    return spark.createDataFrame(
        rows, "since int, via string, predicate string, index string, lookup boolean, single boolean"
    )


def relation_rules(spark: SparkSession, names: Names) -> DataFrame:
    """(since, via, predicate) of every relation; the name follows from the predicate."""
    rows = []
    for text, via in ((_ITEM_RELATIONS, ""), (_CONTEXT_RELATIONS, names.full("context"))):
        for since, predicates in _lines(text):
            rows += [(RULE_SETS.index(since), via, names.full(p)) for p in predicates.split()]
    for role in ROLES:
        if role != ROLE_NOT_READ:
            rows += [(1, names.full("context"), names.full(p)) for p in (role, f"{role}Of")]
    return spark.createDataFrame(rows, "since int, via string, predicate string")


def freetext_groups(spark: SparkSession) -> DataFrame:
    """(index, bucket): which fields a free text bucket unites."""
    rows = [(name, "place") for name in PLACE_FIELDS]
    rows += [(name, "actor") for name in ACTOR_FIELDS]
    rows += [(name, "time") for name in TIME_FIELDS]
    rows += [(name, "item") for name in INDEXES if name.startswith("item") and name not in ("item", "itemId")]
    members = {name for name, _ in rows} | {
        i.name for i in INDEXES.values() if i.is_public and i.type in (LOWER, ANALYZED)
    }
    buckets = {"text", "strict", "item", "place", "actor", "time"}
    for name in sorted(members - buckets):
        rows += [(name, "text"), (name, "strict")]
    return spark.createDataFrame(rows, "index string, bucket string")
