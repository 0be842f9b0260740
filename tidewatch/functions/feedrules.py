"""Severity of the reports of feeds: each feed is a list of rules, and the first rule that holds says how severe a report is.

A report is a row of text, status, code, measure, places and days; a feed's rules say what these are (for storms the
text is the event, the status its official severity and the code its urgency).  A rule holds if all that it names
holds; a null meets no condition.  Rules are data: a further feed is a further entry.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    level: str
    text: str | None = None  # a pattern found in the text
    status: tuple[str, ...] = ()  # one of these
    code: str | None = None  # a pattern found in the code
    least: float | None = None  # the measure's least value
    above: float | None = None  # a value that the measure exceeds
    places: int | None = None  # the least number of places
    days: float | None = None  # at most so many days are left


class FeedRules(NamedTuple):
    category: str
    hours: float  # a key that was reported isn't again for so long
    rules: tuple[Rule, ...]
    otherwise: str | None = "low"  # None: other rows aren't reported
    least: float | None = None  # rows below aren't reported
    about: str | None = None  # only rows whose text has this pattern are reported


C, H, M, L = "critical", "high", "medium", "low"


def steps(critical: float | None, high: float | None, medium: float | None, status: tuple[str, ...] = ()) -> tuple[Rule, ...]:
    """Rules of a mere ladder of the measure."""
    return tuple(Rule(level, status=status, least=bound) for level, bound in ((C, critical), (H, high), (M, medium)) if bound is not None)


#: Each feed's category, hours without repeats, and rules in their order.
FEEDS: dict[str, FeedRules] = {
    # text: event type, code: its kind, measure: fatalities
    "armed_conflict": FeedRules("conflict", 48, (
        Rule(C, least=50), Rule(H, least=10), Rule(C, code="(?i)sexual violence|chemical weapon|mass killing|ethnic cleansing"), Rule(C, text="(?i)explosion", least=5),
        Rule(H, text="(?i)battle|explosion|remote violence"), Rule(H, text="(?i)violence against civilians", above=0),
        Rule(M, text="(?i)riot|violence against civilians"), Rule(M, code="(?i)armed clash"),
    )),
    # status: squawk
    "aircraft_squawks": FeedRules("security", 1, (Rule(C, status=("7500",)), Rule(M, status=("7600",)), Rule(H, status=("7700",))), None),
    # status: navigation status
    "ship_distress": FeedRules("disaster", 1, (Rule(C, status=("14",)), Rule(H, status=("7",))), None),
    # text: aircraft and description, measure: fatalities
    "aviation_incidents": FeedRules("transportation", 168, (
        Rule(C, least=50), Rule(C, text=r"(?i)airliner|a[23]\d{2}|b7[3-8]\d|boeing|airbus|737|747|777|787|a320|a330|a350|a380", least=10), Rule(H, least=10),
        Rule(H, text="(?i)military|fighter|bomber|transport|cargo|helicopter crash", least=1), Rule(M, least=1),
        Rule(M, text="(?i)hull loss|destroyed|ditching|crash land|emergency landing|engine failure|fire"),
    )),
    # status: kind of movement
    "naval_groups": FeedRules("conflict", 6, (Rule(H, status=("deployment",)),), M),
    # status: overview of a catalog, else a launch or decay
    "satellites": FeedRules("technology", 48, (Rule("info", status=("overview",)),), M),
    # text: vendor, status: use in ransom campaigns, days: until due
    "exploited_flaws": FeedRules("security", 168, (
        Rule(C, status=("Known",)), Rule(C, text="(?i)microsoft|apple|google|cisco|fortinet|palo alto|citrix|vmware|ivanti|adobe"), Rule(H, days=14), Rule(M, days=30),
    )),
    # status: commodity code, measure: value
    "commodity_flows": FeedRules("economy", 168, (
        Rule(C, status=("2844",)), Rule(C, above=10_000_000_000), Rule(H, status=("8542", "2709")), Rule(H, above=1_000_000_000), Rule(M, above=100_000_000),
    ), least=10_000_000),
    # text: regime and description
    "union_sanctions": FeedRules("security", 336, (
        Rule(C, text="(?i)russia|belarus|iran|north korea|dprk|syria|terrorism|chemical weapons|cyber"),
        Rule(H, text="(?i)myanmar|burma|mali|libya|venezuela|south sudan|somalia|central african|guinea|afghanistan|haiti|nicaragua|human rights|arms embargo|proliferation"),
        Rule(M, text="(?i)tunisia|lebanon|moldova|bosnia|misappropriation|threat to peace"),
    )),
    # measure: radiative power
    "fires": FeedRules("disaster", 6, steps(1000, 400, 100)),
    # status: kind, measure: share of aircraft
    "navigation_jamming": FeedRules("electronic_warfare", 4, (
        Rule(C, status=("spoofing",)), Rule(C, status=("military",), least=0.92), Rule(H, status=("military",), least=0.75), Rule(H, least=0.85), Rule(M, least=0.65), Rule(M, status=("civilian",)),
    ), least=0.5),
    # status: alert level, code: colour for aviation
    "volcanoes": FeedRules("disaster", 168, (
        Rule(C, status=("WARNING",)), Rule(C, code=r"(?i)\Ared\z"), Rule(H, status=("WATCH",)), Rule(H, code=r"(?i)\Aorange\z"), Rule(M, status=("ADVISORY",)), Rule(M, code=r"(?i)\Ayellow\z"),
    )),
    # text: title and description
    "nuclear_events": FeedRules("science", 72, (
        Rule(C, text=r"(?i)ines\s*level\s*[4-7]|nuclear\s+accident|major\s+accident|large\s+release|emergency\s+declared|radiation\s+emergency|nuclear\s+emergency|meltdown|core\s+damage"),
        Rule(H, text=r"(?i)ines\s*level\s*3|serious\s+incident|lost\s+(?:radioactive\s+)?source|orphan\s+source|confirmed\s+contamination|significant\s+radiation|radiation\s+injury|radioactive\s+material\s+(?:lost|stolen|missing)"),
        Rule(M, text=r"(?i)ines\s*level\s*[12]|nuclear\s+incident|precautionary|tritium|radioactive\s+(?:leak|release|discharge)|abnormal\s+occurrence|reactor\s+shutdown|unplanned\s+shutdown"),
    )),
    # text: charges, places: nationalities
    "wanted_notices": FeedRules("security", 720, (
        Rule(C, text="(?i)terrorism|war crime|genocide|human trafficking|chemical|biological|nuclear|weapons of mass|mass murder|crime against humanity"),
        Rule(H, text="(?i)murder|homicide|kidnapping|armed robbery|drug trafficking|money laundering|cybercrime|sexual exploitation|child abuse|organized crime|extortion"),
        Rule(H, places=3), Rule(M, places=2),
    )),
    # measure: score
    "internet_outages": FeedRules("technology", 0.5, steps(500, 100, 30), least=30),
    # status: kind of price, measure: the volatility index, or the change in per cent without its sign
    "markets": FeedRules("economy", 24, (
        *steps(40, 30, 25, ("volatility",)), *steps(6, 4, 2, ("index",)), *steps(None, 20, 10, ("crypto",)), *steps(None, 10, 5, ("commodity",)),
    )),
    # text: event, status: official severity, code: urgency
    "storms": FeedRules("weather", 72, (
        Rule(C, text="(?i)tornado warning|hurricane warning|tsunami warning|extreme wind warning|flash flood emergency|storm surge warning|nuclear power plant warning"),
        Rule(H, text="(?i)tornado watch|hurricane watch|severe thunderstorm warning|blizzard warning|ice storm warning|flood warning|winter storm warning|fire weather warning|red flag warning|excessive heat warning"),
        Rule(C, status=("Extreme",)), Rule(C, status=("Severe",), code=r"\AImmediate\z"), Rule(H, status=("Severe",)), Rule(L, status=("Minor", "Unknown")), Rule(H, code=r"\AImmediate\z"),
    ), M),
    # text: title, description and programme, code: title
    "treasury_sanctions": FeedRules("security", 336, (
        Rule(C, text="(?i)russia|iran|north korea|dprk|syria|china|prc|belarus|venezuela|cuba|terrorism|wmd|weapons of mass destruction|proliferation|cyber"),
        Rule(H, text="(?i)narcotics|transnational criminal|magnitsky|global sanctions|human rights|glomag|caatsa|ukraine"),
        Rule(M, code="(?i)designation|addition|update"),
    )),
    # text: name, description and tags, measure: indicators
    "threat_pulses": FeedRules("security", 168, (
        Rule(C, text=r"(?i)apt\d+|lazarus|cozy bear|fancy bear|sandworm|equation group|turla|apt28|apt29|apt41|hafnium|nobelium|lapsus|scattered spider|lockbit|blackcat|alphv|cl0p|rhysida"),
        Rule(H, text="(?i)ransomware|zero-day|0-day|supply.chain|critical vulnerability|remote code execution|rce|wiper|backdoor|rootkit|botnet|c2|command.and.control"), Rule(H, least=100),
        Rule(M, text="(?i)phishing|credential.?theft|spear.?phish|malware|trojan|exploit|brute.?force|ddos|data.?breach|exfiltration"), Rule(M, least=20),
    )),
    # text: title and abstract, code: class
    "patents": FeedRules("technology", 720, (
        Rule(C, text="(?i)hypersonic|nuclear weapon|thermonuclear|fission warhead|fusion weapon|directed.energy weapon|electromagnetic pulse|EMP device|offensive cyber|zero.day exploit|biological weapon|chemical weapon"),
        Rule(C, code=r"\A(?:G21J|F42B15)"),
        Rule(H, text="(?i)missile guidance|anti.satellite|ASAT|cruise missile|ballistic missile|electronic warfare|radar jamming|sonar countermeasure|unmanned combat|stealth technology|classified technology|military satellite|spy satellite|drone swarm"),
        Rule(H, code=r"\A(?:F41|F42|H04K|B63G)"),
        Rule(M, text="(?i)dual.use|satellite communication|cyber.physical|advanced material|armor penetration|explosives detection|biometric surveillance|facial recognition.surveillance|military AI|autonomous weapon|lethal autonomous"),
        Rule(M, code=r"\A(?:G01S|H04L9|B64U)"),
    )),
    # measure: customers
    "power_outages": FeedRules("infrastructure", 6, steps(500_000, 100_000, 25_000)),
    # text: name and type, status: state, places: countries
    "humanitarian_disasters": FeedRules("humanitarian", 168, (
        Rule(C, places=5), Rule(C, text="(?i)earthquake|tsunami|cyclone|hurricane|typhoon|volcano|famine|genocide|armed conflict|complex emergency"),
        Rule(H, text="(?i)flood|epidemic|drought|landslide|wildfire|storm|displacement|refugee"), Rule(H, status=("alert",)), Rule(M, status=("ongoing",)),
    )),
    # measure: counts a minute
    "radiation": FeedRules("science", 24, steps(1000, 350, 100)),
    # measure: magnitude
    "quakes": FeedRules("disaster", 48, steps(7, 6, 5)),
    # text: message
    "space_weather": FeedRules("climate", 24, (
        Rule(C, text=r"\b(?:G5|R5|S5)\b"), Rule(H, text=r"\b(?:G4|R4|S4)\b"), Rule(M, text=r"\b(?:G3|R3|S3)\b"),
    ), about="(?i)GEOMAGNETIC STORM|SOLAR RADIATION STORM|RADIO BLACKOUT"),
    # text: title and summary
    "tsunamis": FeedRules("weather", 72, (Rule(C, text="(?i)warning"), Rule(H, text="(?i)watch"), Rule(M, text="(?i)advisory"), Rule(L, text="(?i)information|statement|bulletin")), M),
    # text: name and description, measure: people, places: countries
    "displacement": FeedRules("humanitarian", 336, (
        Rule(C, least=1_000_000), Rule(C, places=8), Rule(C, text="(?i)mass displacement|ethnic cleansing|genocide|famine|war|armed conflict|siege|emergency declaration"),
        Rule(H, least=100_000), Rule(H, places=4), Rule(H, text="(?i)refugee crisis|influx|border surge|forced displacement|internal displacement|humanitarian emergency|protection crisis"),
        Rule(M, least=10_000), Rule(M, places=2),
    )),
    # text: title and description
    "disease_outbreaks": FeedRules("health", 72, (
        Rule(C, text=r"(?i)grade\s*3|pheic|public health emergency of international concern|ebola|marburg|hemorrhagic fever|plague|smallpox|pandemic declared"),
        Rule(H, text=r"(?i)grade\s*2|novel\s+(?:virus|strain|pathogen)|high\s+risk|large(?:\s|-)scale|significant outbreak|multi-country|spreading|cholera.*deaths|outbreak.*killed|mpox.*grade"),
        Rule(M, text=r"(?i)grade\s*1|confirmed\s+(?:cases|outbreak)|outbreak update|cases\s+reported|cluster|avian\s+influenza|meningitis|yellow fever|dengue|lassa"),
    )),
}


def _holds(rule: Rule) -> Column:
    wanted = [
        None if rule.text is None else F.col("text").rlike(rule.text),
        F.col("status").isin(*rule.status) if rule.status else None,
        None if rule.code is None else F.col("code").rlike(rule.code),
        None if rule.least is None else F.col("measure") >= float(rule.least),
        None if rule.above is None else F.col("measure") > float(rule.above),
        None if rule.places is None else F.col("places") >= rule.places,
        None if rule.days is None else F.col("days") <= float(rule.days),
    ]
    held = F.lit(True)
    for condition in wanted:
        held = held if condition is None else held & condition
    return held


def _by_feed(value, feeds: dict[str, FeedRules]) -> Column:
    out = F
    for name, feed in feeds.items():
        out = out.when(F.col("feed") == name, value(feed))
    return out


def severity(feeds: dict[str, FeedRules] = FEEDS) -> Column:
    """The severity of a row of (feed, text, status, code, measure, places, days); null for rows that aren't reported, and for unknown feeds."""

    def of(feed: FeedRules) -> Column:
        out = F.when(~F.coalesce(F.col("measure") >= float(feed.least), F.lit(False)), None) if feed.least is not None else F
        out = out.when(~F.coalesce(F.col("text").rlike(feed.about), F.lit(False)), None) if feed.about is not None else out
        for rule in feed.rules:
            out = out.when(_holds(rule), rule.level)
        return out.otherwise(F.lit(feed.otherwise).cast("string"))

    return _by_feed(of, feeds)


def reported(rows: DataFrame, feeds: dict[str, FeedRules] = FEEDS) -> DataFrame:
    """The rows that are reported, with their severity and category; the rules are looked at once a row (a filter on the severity would repeat them)."""
    return rows.select("*", F.explode(F.array_compact(F.array(severity(feeds)))).alias("severity")).withColumn("category", category(feeds))


def category(feeds: dict[str, FeedRules] = FEEDS) -> Column:
    """A feed's category; an emergency in the air that isn't an unlawful act or a lost radio is a disaster."""
    return F.when((F.col("feed") == "aircraft_squawks") & (F.col("status") == "7700"), "disaster").otherwise(_by_feed(lambda f: F.lit(f.category), feeds))


def quiet_seconds(feeds: dict[str, FeedRules] = FEEDS) -> Column:
    """For how long a feed's key isn't reported again."""
    return _by_feed(lambda f: F.lit(int(f.hours * 3600)), feeds)
