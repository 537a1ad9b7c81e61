"""Controlled vocabularies of facts, each in alphabetical order of its entries."""

CATEGORIES = ["biography", "goal", "habit", "interest", "negative_trait", "opinion", "preference", "project", "relationship", "skill", "value"]
_PLURALS_IN_Y = {"biographies": "biography", "hobbies": "interest"}
CATEGORY_SYNONYMS = {
    "aspiration": "goal", "belief": "opinion", "bio": "biography", "family": "relationship", "flaw": "negative_trait", "job": "biography",
    "like": "preference", "routine": "habit", "work": "project",
    **_PLURALS_IN_Y,
}
PREDICATES = sorted(
    """unknown admires aspires_to attended avoids believes builds collaborates_with conflicts_with decided
    dislikes enjoys excels_at experienced fears follows founded friends_with graduated_from hates identifies_as
    interested_in learned lives_in lost loves maintains manages married_to mentored_by monitors owns parents plays
    practices prefers prioritizes raised_by raised_in relates_to reports_to struggles_with studies values wants_to works_at""".split()
)
IDENTITY_PREDICATES = sorted(
    "avoids aspires_to believes builds decided dislikes enjoys excels_at experienced fears follows founded hates identifies_as lost loves maintains monitors plays practices prefers prioritizes struggles_with values".split()
)
ANCHOR_PREDICATES = sorted("believes decided identifies_as prioritizes values".split())
PREDICTION_PREDICATES = sorted("avoids builds dislikes enjoys excels_at fears follows hates loves maintains manages monitors plays practices prefers struggles_with trades".split())
BIOGRAPHY_PREDICATES = sorted("attended founded graduated_from lives_in married_to owns parents raised_by raised_in reports_to works_at".split())
#: Written variants of each canonical predicate.
VARIANTS = {
    "admires": ["looks up to", "respects"], "aspires_to": ["hopes to"], "builds": ["building", "built", "creating", "developing"],
    "collaborates_with": ["collaborated with", "works with"], "conflicts_with": ["clashes with", "disagrees with"], "dislikes": ["does not like", "doesn't like"],
    "enjoys": ["likes"], "excels_at": ["good at", "good_at", "skilled in", "skilled_in", "talented at"], "experienced": ["experiences"],
    "fears": ["afraid of", "afraid_of", "anxious about", "worries about", "worries_about"], "follows": ["keeps up with", "tracks"],
    "friends_with": ["friend of", "is friends with"], "identifies_as": ["considers self"], "lives_in": ["based in", "based_in", "resides in", "resides_in"],
    "maintains": ["keeps"], "manages": ["managed"], "married_to": ["spouse is"], "mentored_by": ["learned from", "mentor is"], "monitors": ["observes"],
    "owns": ["has"], "parents": ["father of", "mother of", "parent of"], "practices": ["engages in", "engages_in", "practiced"],
    "raised_by": ["brought up by", "child of", "daughter of", "son of"], "raised_in": ["grew up in", "grew_up_in"],
    "relates_to": ["brother of", "related to", "sibling of", "sister of"], "reports_to": ["managed by", "works under"],
    "struggles_with": ["has difficulty", "has_difficulty", "struggled_with"], "studies": ["learning", "researching", "studied", "studying"],
    "values": ["cares about", "cares_about", "holds dear", "prizes", "treasures"], "works_at": ["employed at", "employed_at", "worked_at", "works for", "works_for"],
}
ALIASES = {v: p for p, vs in VARIANTS.items() for v in vs}
INTENTS = {
    "curious": ["asked", "asked about", "considered", "curious", "inquired", "looked into", "researched", "thinking about", "wondered"],
    "historical": ["did", "formerly", "had", "historical", "once", "past", "previously", "used to", "was"],
    "learning": ["developing", "exploring", "improving", "learning", "studying", "training", "working on"],
}
TEMPORAL = {
    "current": ["active", "current", "now", "ongoing", "present", "still"],
    "past": ["ended", "former", "historical", "no longer", "past", "previous", "quit", "stopped", "was"],
}
FACT_CLASSES = {
    "event": ["achievement", "completed", "event", "events", "happened", "historical event", "milestone", "occurred", "one-time"],
    "state": ["active", "condition", "current", "habit", "ongoing", "preference", "routine", "state", "states", "status"],
}
TIERS = {
    "context": ["artifact", "context", "conversational", "ephemeral", "one-off", "t3"],
    "identity": ["anchor", "biographical", "identity", "permanent", "t1"],
    "situational": ["active", "current", "mutable", "situational", "t2"],
}
SCOPES = {"chatgpt": "personal", "claude_code": "project", "claude_web": "personal"}
EXCLUDED = sorted(
    ["authoring process", "block #", "block number", "blind authoring", "brief assembly", "collective review", "d-0", "design decision", "embedding model",
     "extraction pipeline", "extraction process", "fact extraction", "identity block", "identity layer", "mcp server", "pipeline step", "sqlite", "vector database"]
)
DOMAINS = {"music": ["band", "chord", "concert", "guitar", "song"], "trading": ["chart", "entry", "loss", "profit", "scalp", "setup", "trade"]}


def inverted(groups: dict[str, list[str]]) -> dict[str, str]:
    return {v: k for k, vs in groups.items() for v in vs}
