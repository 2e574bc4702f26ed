"""Index catalogue and relation names: data that the operators look up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

ANALYZED = "ANALYZED"
LOWER = "TOLOWERCASE"
VERBATIM = "VERBATIM"
YEAR = "ISO8601DATEYEAR"
SPATIAL = "SPATIAL_VIRTUAL"
COORDINATE = "SPATIAL_COORDINATE"

# Name | type | sortable or internal | title of every index.
_INDEXES = """
itemId | VERBATIM | sortable | Identifierare
serviceName | TOLOWERCASE | sortable | Ursprungstjänst
serviceOrganization | TOLOWERCASE | sortable | Ursprungsorganisation
text | ANALYZED |  | Fritext, generellt
strict | TOLOWERCASE |  | Fritext, generellt - ostammat
subject | TOLOWERCASE |  | Ämnesavgränsning
collection | TOLOWERCASE |  | Namn på samlingen som objektet tillhör
dataQuality | TOLOWERCASE | sortable | Beskrivningsnivå
mediaType | TOLOWERCASE |  | Avgränsning av mediatyper
multipleReplaces | VERBATIM | sortable | Identifierare för objekt som detta objekt ersätter
stringProtocolVersion | VERBATIM |  | Protokollversion för posten
item | ANALYZED | sortable | Fritext i entitetsfält
itemType | TOLOWERCASE | sortable | Typ av objekt
itemSuperType | TOLOWERCASE | sortable | Huvudtyp av objekt
itemClass | TOLOWERCASE |  | Objektets klass, kategorisering eller klassifikation
itemClassName | TOLOWERCASE |  | Klass eller kategori, om det inte finns en klassificeringsresurs
itemName | TOLOWERCASE |  | Objektets huvudsakliga benämning eller sakord
itemSpecification | TOLOWERCASE |  | Modellbeteckning eller liknande
itemTitle | TOLOWERCASE |  | Titel eller verksnamn
itemLabel | TOLOWERCASE | sortable | Huvudsaklig beskrivning av objektet - klassifikation, sakord el dyl
itemMark | ANALYZED |  | Fritext i item mark
itemInscription | ANALYZED |  | Fritext i item inscription
itemDescription | ANALYZED |  | Fritext i beskrivningsfält
itemKeyWord | TOLOWERCASE |  | Nyckelord
itemMotiveWord | TOLOWERCASE |  | Ord som förekommer som beskrivning av ett motiv i ett bild- eller målningsobjekt
itemMaterial | TOLOWERCASE |  | Material som objektet består av
itemTechnique | TOLOWERCASE |  | Teknik för att producera objektet
itemStyle | TOLOWERCASE |  | Stil som präglar objektet
itemColor | TOLOWERCASE |  | Färg som präglar objektet
itemNumber | TOLOWERCASE |  | Inventarienummer eller annan identifikation av objektet
itemLicense | TOLOWERCASE | sortable | Licens för användning av objektet (uri)
createdDate | VERBATIM | sortable | Datum då posten skapades i källsystemet (yyyy-mm-dd)
lastChangedDate | VERBATIM | sortable | Datum då posten ändrades i källsystemet (yyyy-mm-dd)
theme | TOLOWERCASE |  | Tema
buildDate | VERBATIM | sortable | Datum då posten publicerades
placeName | TOLOWERCASE |  | Annat platsnamn [*]
cadastralUnit | TOLOWERCASE |  | Fastighetsbeteckning [*]
placeTermId | TOLOWERCASE |  | Plats-ID hos auktoritet [*]
placeTermAuth | TOLOWERCASE |  | Auktoritet för plats-ID [*]
placeTerm | TOLOWERCASE |  | Plats-ID (uri)
continentName | TOLOWERCASE |  | Kontinent [*]
countryName | TOLOWERCASE |  | Land, namn [*]
countyName | TOLOWERCASE |  | Län, namn [*]
municipalityName | TOLOWERCASE |  | Kommun, namn [*]
provinceName | TOLOWERCASE |  | Landskap, namn [*]
parishName | TOLOWERCASE |  | Socken, namn [*]
country | TOLOWERCASE |  | Land, kod [*]
county | TOLOWERCASE |  | Län, kod [*]
municipality | TOLOWERCASE |  | Kommun, kod [*]
province | TOLOWERCASE |  | Landskap, kod [*]
parish | TOLOWERCASE |  | Socken, kod [*]
place | ANALYZED |  | Var - Fritext i geografiska data
boundingBox | SPATIAL_VIRTUAL |  | Spatial sökning med omslutande rektangel
pointDistance | SPATIAL_VIRTUAL |  | Spatial närhetssökning med angiven punkt och radie
firstName | TOLOWERCASE |  | Förnamn [*]
surname | TOLOWERCASE |  | Efternamn [*]
gender | TOLOWERCASE |  | Kön [*]
fullName | TOLOWERCASE |  | Fullständigt namn ([förnamn] [efternamn]) [*]
organization | TOLOWERCASE |  | Organisation [*]
title | TOLOWERCASE |  | Titel (person) [*]
nameId | TOLOWERCASE |  | Auktoriserat ID [*]
nameAuth | TOLOWERCASE |  | Auktoritet för namn [*]
actor | ANALYZED |  | Vem - Fritext i person- och organisationsdata
agent | TOLOWERCASE |  | Agent, uri
fromTime | ISO8601DATEYEAR |  | Tidpunkt eller start på tidsintervall (årtal enligt ISO 8601) [*]
toTime | ISO8601DATEYEAR |  | Tidpunkt eller slut på tidsintervall (årtal enligt ISO 8601) [*]
fromPeriodName | TOLOWERCASE |  | Tidpunkt eller start på tidsintervall, namn [*]
toPeriodName | TOLOWERCASE |  | Tidpunkt eller slut på tidsintervall, namn [*]
fromPeriodId | TOLOWERCASE |  | Tidpunkt eller start på tidsintervall, kod [*]
toPeriodId | TOLOWERCASE |  | Tidpunkt eller slut på tidsintervall, kod [*]
fromPeriod | TOLOWERCASE |  | Tidpunkt eller start på tidsintervall, uri
toPeriod | TOLOWERCASE |  | Tidpunkt eller slut på tidsintervall, uri
periodAuth | TOLOWERCASE |  | Auktoritet för perioder [*]
eventName | TOLOWERCASE |  | Namn på en händelse [*]
eventAuth | TOLOWERCASE |  | Auktoritet för händelser [*]
event | TOLOWERCASE |  | Händelse, uri
time | ANALYZED |  | När - Fritext i tidsdata
contextLabel | TOLOWERCASE |  | Sammanhang enligt ändlig lista, beskrivning
contextType | TOLOWERCASE |  | Sammanhang enligt ändlig lista, nyckelvärde
contextSuperType | TOLOWERCASE |  | Huvudsammanhang enligt ändlig lista, nyckelvärde
relUri | VERBATIM |  | Är relaterat på något sätt till annat objekt (uri)
containsInformationAbout | VERBATIM |  | Har information om (uri)
containsObject | VERBATIM |  | Innehåller objekt (uri)
isContainedIn | VERBATIM |  | Innehålls i objekt (uri)
hasBeenUsedIn | VERBATIM |  | Används i (uri)
hasChild | VERBATIM |  | Har underordnat objekt (uri)
hasFind | VERBATIM |  | Har fynd (uri)
hasImage | VERBATIM |  | Har bild (uri)
hasObjectExample | VERBATIM |  | Har objektexempel (uri)
isObjectExampleFor | VERBATIM |  | Är objektexempel för (uri)
hasParent | VERBATIM |  | Har överordnat objekt (uri)
hasPart | VERBATIM |  | Har del (uri)
isDescribedBy | VERBATIM |  | Beskrivs av (uri)
describes | VERBATIM |  | Beskriver (uri)
isFoundIn | VERBATIM |  | Finns i (uri)
isPartOf | VERBATIM |  | Är del av annat objekt (uri)
isRelatedTo | VERBATIM |  | Är relaterat till annat objekt (uri)
isVisualizedBy | VERBATIM |  | Visualiseras av annat objekt (uri)
sameAs | VERBATIM |  | Samma som (uri)
visualizes | VERBATIM |  | Visualiserar objekt (uri)
isMentionedBy | VERBATIM |  | Nämns av (uri)
mentions | VERBATIM |  | Nämner (uri)
addedToIndexDate | VERBATIM | sortable | Datum posten lades till i indexet (yyyy-mm-dd) - obs att detta datum är ungefärligt då det beror på skördefrekvens för källtjänsten, beräknas som max(källtjänstens första indexeringsdatum, createdDate)
has_former_or_current_owner | VERBATIM |  | Har nuvarande eller tidigare ägare (uri)
has_former_or_current_keeper | VERBATIM |  | Har nuvarande eller tidigare förvaltare (uri)
was_created_by | VERBATIM |  | Skapades av (uri)
right_held_by | VERBATIM |  | Rättigheter ägs av (uri)
was_present_at | VERBATIM |  | Var närvarande vid händelse (uri)
occurred_in_the_presence_of | VERBATIM |  | Händelsen skedde i närvaro av (uri)
had_participant | VERBATIM |  | Händelsen hade deltagare (uri)
participated_in | VERBATIM |  | Deltog i händelse (uri)
is_current_or_former_member_of | VERBATIM |  | Är eller var tidigare medlem av (uri)
has_current_or_former_member | VERBATIM |  | Har eller hade medlem (uri)
child | VERBATIM |  | Var förälder till (uri)
parent | VERBATIM |  | Var barn till (uri)
mother | VERBATIM |  | Har mor (uri)
father | VERBATIM |  | Har far (uri)
client | VERBATIM |  | Beställare (uri)
composer | VERBATIM |  | Kompositör (uri)
author | VERBATIM |  | Författare (uri)
architect | VERBATIM |  | Arkitekt (uri)
inventor | VERBATIM |  | Uppfinnare (uri)
scenographer | VERBATIM |  | Scenograf (uri)
designer | VERBATIM |  | Designer (uri)
producer | VERBATIM |  | Producent (uri)
organizer | VERBATIM |  | Arrangör (uri)
director | VERBATIM |  | Regissör (uri)
photographer | VERBATIM |  | Fotograf (uri)
painter | VERBATIM |  | Målare (uri)
builder | VERBATIM |  | Byggare (uri)
masterBuilder | VERBATIM |  | Byggmästare (uri)
constructionClient | VERBATIM |  | Byggherre (uri)
engraver | VERBATIM |  | Gravör (uri)
mintmaster | VERBATIM |  | Myntmästare (uri)
artist | VERBATIM |  | Konstnär (uri)
designEngineer | VERBATIM |  | Konstruktör (uri)
carpenter | VERBATIM |  | Snickare (uri)
mason | VERBATIM |  | Murare (uri)
technician | VERBATIM |  | Tekniker (uri)
publisher | VERBATIM |  | Förläggare (uri)
publicist | VERBATIM |  | Publicist (uri)
musician | VERBATIM |  | Musiker (uri)
actorActress | VERBATIM |  | Skådespelare (uri)
printer | VERBATIM |  | Tryckare (uri)
signer | VERBATIM |  | Påskrift av (uri)
finder | VERBATIM |  | Upphittare (uri)
abandonee | VERBATIM |  | Förvärvare (uri)
intermediary | VERBATIM |  | Förmedlare (uri)
buyer | VERBATIM |  | Köpare (uri)
seller | VERBATIM |  | Säljare (uri)
generalAgent | VERBATIM |  | Generalagent (uri)
donor | VERBATIM |  | Givare (uri)
depositor | VERBATIM |  | Deponent (uri)
reseller | VERBATIM |  | Återförsäljare (uri)
inventoryTaker | VERBATIM |  | Inventerare (uri)
excavator | VERBATIM |  | Grävare (uri)
examinator | VERBATIM |  | Undersökare (uri)
conservator | VERBATIM |  | Konservator (uri)
archiveContributor | VERBATIM |  | Arkivbildare (uri)
interviewer | VERBATIM |  | Intervjuare (uri)
informant | VERBATIM |  | Informant (uri)
patentHolder | VERBATIM |  | Patentinnehavare (uri)
user | VERBATIM |  | Brukare (uri)
scannerOperator | VERBATIM |  | Skanneroperatör (uri)
pictureEditor | VERBATIM |  | Bildredaktör (uri)
employer | VERBATIM |  | Arbets- eller uppdragsgivare (uri)
marriedTo | VERBATIM |  | Gift med (uri)
mediaLicense | TOLOWERCASE |  | Licens för ingående bild/media(uri)
mediaMotiveWord | ANALYZED |  | Bildmotiv för ingående bilder/media
byline | TOLOWERCASE | sortable | Byline för ingående bild/media(uri)
copyright | TOLOWERCASE | sortable | Copyright för ingående bild/media(uri)
thumbnailSource | VERBATIM |  | Källa för tumnagel
lowresSource | VERBATIM |  | Källa för lågupplöst bild
highresSource | VERBATIM |  | Källa för högupplöst bild
thumbnailExists | TOLOWERCASE | sortable | Om objektet har en tumnagelbild (j/n)
geoDataExists | TOLOWERCASE | sortable | Om objektet har spatial data (j/n)
timeInfoExists | TOLOWERCASE | sortable | Om objektet har tidsangivelse (i fromTime/toTime) (j/n)
century | ISO8601DATEYEAR |  | De århundraden som objektet omfattar
decade | ISO8601DATEYEAR |  | De årtionden som objektet omfattar
thumbnail | VERBATIM |  | url till tumnagel
_pres | VERBATIM | internal | presentationsblocket
_rdf | VERBATIM | internal | rdf
_service | VERBATIM | internal | tjänst
_htmlurl | VERBATIM | internal | html-representation, url
_museumdaturl | VERBATIM | internal | museumdat-representation, url
_lon | SPATIAL_COORDINATE | internal | longitud för centrumpunkt
_lat | SPATIAL_COORDINATE | internal | latitud för centrumpunkt
_relations | VERBATIM | internal | relationer
rec.identifier | VERBATIM | internal | identifierare
"""

# Relation names that are each other's inverse.
_PAIRS = """
isPartOf hasPart
containsObject isContainedIn
isFoundIn hasFind
hasChild hasParent
visualizes isVisualizedBy
isDescribedBy describes
hasObjectExample isObjectExampleFor
isMentionedBy mentions
multipleReplaces isReplacedBy
child parent
has_former_or_current_owner is_former_or_current_owner_of
has_former_or_current_keeper is_former_or_current_keeper_of
has_created was_created_by
has_right_on right_held_by
was_present_at occurred_in_the_presence_of
had_participant participated_in
is_current_or_former_member_of has_current_or_former_member
"""

# Roles; the inverse of a role is its name with "Of".
ROLES = (
    "client composer author architect inventor scenographer designer producer organizer director "
    "photographer painter builder masterBuilder constructionClient engraver mintmaster artist "
    "designEngineer carpenter mason technician publisher publicist musician actorActress printer "
    "signer finder abandonee intermediary buyer seller generalAgent donor depositor reseller "
    "inventoryTaker excavator examinator conservator archiveContributor interviewer informant "
    "patentHolder user scannerOperator pictureEditor employer"
).split()

# Relations with an inverse name that does not lead back to them.
ONE_WAY = {
    "father": "child",
    "mother": "child",
    "hasBeenUsedIn": "isRelatedTo",
    "hasImage": "isRelatedTo",
    "containsInformationAbout": "isMentionedBy",
}

# Relations that are their own inverse.
SYMMETRIC = ("isRelatedTo", "sameAs", "marriedTo")

# Relations that make two items the same or a replacement of each other.
SAME_AS, REPLACES, REPLACES_PUBLIC, RELATED = "sameAs", "multipleReplaces", "replaces", "isRelatedTo"

# Indexes counted when none are named.
COUNTED_INDEXES = (
    "serviceName serviceOrganization collection subject mediaType dataQuality itemType itemMaterial "
    "itemTechnique contextType fromPeriodName toPeriodName countryName countyName provinceName "
    "municipalityName parishName firstName organization title gender thumbnailExists"
).split()

# Fields that cannot be exported, and public names of internal fields.
NOT_EXPORTED = ("addedToIndexDate", "boundingBox", "pointDistance")
EXPORT_ALIASES = {"lon": "_lon", "lat": "_lat", "url": "_htmlurl"}


@dataclass(frozen=True)
class Index:
    name: str
    title: str
    type: str
    is_public: bool
    is_sortable: bool


def _read_indexes() -> dict[str, Index]:
    found = {}
    for line in _INDEXES.strip().splitlines():
        name, kind, mark, title = (part.strip() for part in line.split("|", 3))
        found[name] = Index(name, title, kind, mark != "internal", mark == "sortable")
    return found


INDEXES = _read_indexes()


def inverse_names() -> dict[str, str]:
    """Inverse name of every relation."""
    names: dict[str, str] = {}
    for line in _PAIRS.strip().splitlines():
        one, other = line.split()
        names |= {one: other, other: one}
    for role in ROLES:
        names |= {role: f"{role}Of", f"{role}Of": role}
    return names | ONE_WAY | {name: name for name in SYMMETRIC}


def index_type(name: str) -> str | None:
    """Type of an index; a context prefix up to the first underscore is cut off."""
    place = name.find("_")
    index = INDEXES.get(name[place + 1:] if place > 0 else name)
    return index.type if index else None


def index_exists(name: str) -> bool:
    """True for a known name, or for one context prefix before a known name."""
    if name in INDEXES:
        return True
    parts = name.split("_")
    return len(parts) == 2 and bool(parts[0]) and parts[1] in INDEXES


def resolve_index(name: str, context_set: str = "") -> str:
    """Index meant by a query: the server's choice is ``text``; the own context set is cut off."""
    if name == "cql.serverChoice":
        return "text"
    if context_set and name.startswith(context_set + "."):
        name = name[len(context_set) + 1:]
    return REPLACES if name == REPLACES_PUBLIC else name


def normalise(index: str, value: str) -> str:
    """Query value in the form in which the index stores it."""
    kind = index_type(index)
    if kind in (LOWER, ANALYZED):
        return value.lower()
    if kind == YEAR:
        return str(int(value))
    return value


def index_catalog(spark: SparkSession) -> DataFrame:
    rows = [(i.name, i.title, i.type, i.is_public, i.is_sortable) for i in INDEXES.values()]
    return spark.createDataFrame(
        rows, "name string, title string, type string, is_public boolean, is_sortable boolean"
    )


def inverse_map(spark: SparkSession) -> DataFrame:
    rows = [(name, inverse, name in ONE_WAY) for name, inverse in inverse_names().items()]
    return spark.createDataFrame(rows, "rel_type string, inverse string, one_way boolean")
