"""Fixed values of the evidence model: enumerations, ranks, shapes, ceilings and cues."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Evidence levels, weakest first, with their ranks.
LEVELS = {
    "UNKNOWN": 0,
    "INFERRED": 5,
    "BREEDER_OBSERVATION": 10,
    "OBSERVATIONAL": 20,
    "EXPRESSION_ASSOCIATION": 30,
    "QTL_GWAS_ASSOCIATION": 40,
    "FINE_MAPPING": 50,
    "FUNCTIONAL_VALIDATION": 60,
    "CAUSAL_VARIANT": 70,
}
COMPARATIVE_CEILING = LEVELS["OBSERVATIONAL"]
TRUTH_FLOOR = LEVELS["FINE_MAPPING"]
#: Ranks of the levels that identify a gene, and of those that map it.
DIRECT_RANKS, MAPPED_RANKS = (60, 70), (40, 50)
DIRECT_EXPERIMENTS = (
    "positional cloning", "mutant mapping", "mutant rescue", "transgenic rescue", "genome editing", "somatic reversion analysis", "variant knock-in",
)
MIN_NEIGHBOURS = MIN_PAPERS = 2

#: Paper states and the ranks that decide what is an advance.
STATES = {
    "DISCOVERED": 0, "METADATA_RESOLVED": 1, "INACCESSIBLE": 2, "FULLTEXT_AVAILABLE": 3, "EXTRACTION_PENDING": 4,
    "EXTRACTED": 5, "REVIEW_REQUIRED": 6, "REJECTED": 7, "ACCEPTED": 8,
}
ACTIONABLE = ("DISCOVERED", "METADATA_RESOLVED", "FULLTEXT_AVAILABLE", "EXTRACTION_PENDING")

#: Experiment ceilings of gene claims. Each of the tables below has the ranks that an experiment can reach at most.
CEILINGS = {
    "positional cloning": 70, "mutant mapping": 70, "variant knock-in": 70, "somatic reversion analysis": 70,
    "genome editing": 60, "morpholino knockdown": 60, "mutant rescue": 60, "transgenic rescue": 60,
    "fine mapping": 50, "gwas": 40, "gwas candidate nomination": 40, "variant calling": 40, "variant genotyping": 40, "linkage analysis": 40,
    "expression analysis": 30, "rt-pcr": 30, "rna-seq": 30, "in situ hybridization": 30,
    "mutant characterization": 20, "literature attribution": 20, "discussion of candidate gene function": 20,
    "review of gene family function": 20, "comparative functional analysis": 20, "comparative mutant analysis": 20,
    "comparative single-cell transcriptomics": 20,
}

PARTICIPATES_CEILINGS = {name: min(rank, 60) for name, rank in CEILINGS.items()} | {
    "transgenic overexpression": 60, "complementation test": 60, "functional analysis": 20, "go term annotation": 20, "candidate gene reasoning": 20,
}
PHENOTYPE_CEILINGS = {
    "genome editing": 60, "morpholino knockdown": 60, "mutant rescue": 60, "transgenic rescue": 60, "variant knock-in": 60,
    "positional cloning": 40, "mutant mapping": 40, "linkage analysis": 40,
    "expression analysis": 30, "rt-pcr": 30, "rna-seq": 30, "in situ hybridization": 30,
    "phenotype description": 20, "mutant characterization": 20, "skeletal analysis": 20, "literature attribution": 20, "breeder description": 10,
}
ANATOMY_CEILINGS = {"phenotype description": 20, "mutant characterization": 20, "skeletal analysis": 20, "breeder description": 10}
SAME_CEILINGS = {
    "lesion sequencing": 70, "complementation test": 60, "fine mapping": 50,
    "variant genotyping": 40, "variant calling": 40, "gwas": 40, "linkage analysis": 40,
    "expression analysis": 30, "locus comparison": 20, "literature attribution": 20, "mutant discovery": 20,
}
INHERITANCE_CEILINGS = {
    "segregation analysis": 40, "linkage analysis": 40, "gwas": 40, "variant genotyping": 40,
    "literature attribution": 20, "genotype notation": 20, "strain description": 20, "phenotype definition": 20, "double mutant description": 20,
    "breeder description": 10, "inference": 5,
}
GENE_PREDICATES = ("associated_with_gene", "associated_with_locus", "caused_by_variant")
INHERITANCE_PREDICATES = ("inherited_as", "dominant_over", "incompletely_dominant_over", "requires_allele", "linked_to", "masks", "composed_of")
#: The table that bounds each predicate; others have no ceiling.
CEILINGS_OF = {
    **dict.fromkeys(GENE_PREDICATES, CEILINGS), "participates_in": PARTICIPATES_CEILINGS, "has_phenotype": PHENOTYPE_CEILINGS,
    "affects_anatomy": ANATOMY_CEILINGS, "putatively_same_as": SAME_CEILINGS, "allele_of": CEILINGS | {"inference": 5},
    **dict.fromkeys(INHERITANCE_PREDICATES, INHERITANCE_CEILINGS),
}

#: Node labels and the prefixes of their ids.
PREFIXES = {
    "OrnamentalTrait": "trait", "Phenotype": "pheno", "Gene": "gene", "GeneticVariant": "var", "Locus": "locus", "BiologicalMechanism": "mech",
    "Anatomy": "anat", "Strain": "strain", "InheritanceMode": "mode", "HumanGene": "hgene", "HumanPhenotype": "hpheno",
    "Paper": "paper", "Evidence": "ev", "Claim": "claim", "Label": "label",
}
_T, _P, _G, _L, _V = "OrnamentalTrait", "Phenotype", "Gene", "Locus", "GeneticVariant"
#: Predicates with the labels that their subjects and objects may have.
SHAPES = {
    "has_phenotype": ((_T,), (_P,)),
    "associated_with_gene": ((_T, _P), (_G,)),
    "associated_with_locus": ((_T, _P), (_L,)),
    "caused_by_variant": ((_T, _P), (_V,)),
    "affects_anatomy": ((_P,), ("Anatomy",)),
    "participates_in": ((_G,), ("BiologicalMechanism",)),
    "ortholog_of": ((_G,), ("HumanGene", _G)),
    "resembles": ((_T, _P), (_T, _P)),
    "co_occurs_with": ((_T, _P), (_T, _P)),
    "modified_by": ((_T, _P), (_G, _L, _V)),
    "epistatic_with": ((_G, _L), (_G, _L)),
    "pleiotropic_with": ((_P,), (_P,)),
    "subsumes": ((_T, _P), (_T, _P)),
    "putatively_same_as": ((_T, "Strain", _P), (_T, "Strain", _P)),
    "human_gene_associated_with": (("HumanGene",), ("HumanPhenotype",)),
    "inherited_as": ((_T, _G, _L, _V), ("InheritanceMode",)),
    "allele_of": ((_V,), (_G, _L)),
    "dominant_over": ((_V,), (_V,)),
    "incompletely_dominant_over": ((_V,), (_V,)),
    "requires_allele": ((_T,), (_V,)),
    "linked_to": ((_G, _L), (_G, _L)),
    "masks": ((_T,), (_T,)),
    "composed_of": ((_T, "Strain"), (_T,)),
}
SYMMETRIC = ("resembles", "co_occurs_with", "epistatic_with", "pleiotropic_with", "putatively_same_as", "linked_to")
#: Predicates that a co-mention may propose, weakest first, and one that it may not.
PREFERENCE = (
    "associated_with_gene", "associated_with_locus", "has_phenotype", "participates_in", "affects_anatomy",
    "modified_by", "ortholog_of", "caused_by_variant", "human_gene_associated_with",
)
UNSUPPORTED = (("ortholog_of", _G, _G),)

#: Cues of evidence levels, of species, and of negation, in order.
LEVEL_CUES = (
    (r"genome[- ]edit\w*", 60), (r"CRISPR", 60), (r"knock[- ]?out", 60), (r"knock[- ]?down", 60), (r"morpholino", 60), (r"phenocop\w+", 60),
    (r"rescue\w*", 60), (r"transgenic", 60), (r"causal variant", 70), (r"responsible for", 70), (r"causative", 70), (r"fine[- ]mapp\w+", 50),
    (r"positional clon\w+", 50), (r"co[- ]?segregat\w+", 50), (r"genome[- ]wide association", 40), (r"\bGWAS\b", 40), (r"\bQTL\b", 40),
    (r"linkage analysis", 40), (r"RNA[- ]?seq", 30), (r"expression\w* (?:level|analys|profil)\w*", 30), (r"\bqPCR\b|\bRT-PCR\b", 30),
    (r"in situ hybridi\w+", 30),
)
SPECIES_CUES = (
    (r"zebrafish|Danio rerio|\bD\. rerio\b", "Danio rerio"), (r"\bmouse\b|\bmice\b|\bmurine\b|Mus musculus", "Mus musculus"),
    (r"\bhuman\b|Homo sapiens|\bpatients?\b", "Homo sapiens"), (r"\bfugu\b|Takifugu", "Takifugu rubripes"),
    (r"stickleback|Gasterosteus", "Gasterosteus aculeatus"), (r"goldfish|Carassius", "Carassius auratus"),
    (r"corn snake|Pantherophis|\bsnake\b", "Pantherophis guttatus"), (r"\bloach\b|Misgurnus|Paramisgurnus", "Misgurnus anguillicaudatus"),
    (r"\bchicken\b|Gallus gallus", "Gallus gallus"), (r"\bXenopus\b", "Xenopus laevis"), (r"\baxolotl\b|Ambystoma", "Ambystoma mexicanum"),
    (r"\bsalmon\b|Salmo salar", "Salmo salar"), (r"\btilapia\b|Oreochromis", "Oreochromis niloticus"), (r"\bcarp\b|Cyprinus carpio", "Cyprinus carpio"),
    (r"\bcatfish\b|Ictalurus", "Ictalurus punctatus"), (r"\bbetta\b|Betta splendens", "Betta splendens"), (r"\bguppy\b|Poecilia reticulata", "Poecilia reticulata"),
)
NEGATION = r"\b(?:no|not|neither|nor|without|failed to|did not|does not|cannot|unlikely|rule[sd]? out|absence of)\b"
ANCHORS = ("medaka", "oryzias", "latipes")
TARGET_SPECIES = "Oryzias latipes"
#: Surface forms that are ordinary words too.
AMBIGUOUS = (
    "black", "white", "blue", "gold", "yellow", "panda", "swallow", "aurora", "longfin", "bigeye", "albino", "rame", "deme", "kagami", "miyuki",
    "guanineless", "few melanophore", "leucophore free", "fused centrum", "scale", "iris", "peritoneum", "dorsal fin", "caudal fin",
    "vertebral column", "melanogenesis", "cAMP signaling", "skeletal system development", "chromatophore development",
    "iridophore development", "dorsoventral patterning", "loss of melanophores", "loss of xanthophores", "fin ray elongation",
    "fin membrane elongation", "shortened body axis", "eyeball protrusion", "eyeball enlargement", "hyper-melanism",
    "iridophore depletion", "ectopic dorsal iridophore", "bioelectric fin size regulation",
)
MIN_SAFE_LENGTH, MAX_MENTIONS, MAX_CANDIDATES = 4, 6, 60
#: Sections whose names hold one of these are no evidence.
NO_EVIDENCE = (
    "reference", "acknowledg", "funding", "author contribution", "supplementary", "supporting information", "conflict of interest",
    "competing interest", "data availability", "ethics", "abbreviation",
)
#: Forms of language tags and vocabulary ids.
LANGUAGE_TAG, VOCABULARY_ID = r"^[a-z]{2,3}(-[A-Za-z0-9]{2,8})*$", r"^bv:[0-9]{4}$"
ABBREVIATIONS = ("et al.", "e.g.", "i.e.", "Fig.", "cf.", "ca.", "approx.")
#: Tokens with a gene symbol's shape that are none: prefixes and their highest numbers, and single ones.
NOT_SYMBOLS = {
    40: ("fig", "figure", "table", "chr", "chromosome", "panel", "lane"),
    20: ("no", "type", "step", "day", "week", "group", "exp", "set", "run"),
}
NOT_SYMBOLS_OTHER = (
    "co2", "h2o", "mgcl2", "cacl2", "nacl2", "kcl2", "naoh", "hcl1", "ph5", "ph6", "ph7", "ph8", "ph9", "f1", "f2", "f3", "p1", "p2", "n1", "n2",
)


def rank_of(level: Column) -> Column:
    """Rank of a level's name; null for what is no level."""
    return F.create_map(*(F.lit(x) for pair in LEVELS.items() for x in pair))[level]


def level_of(rank: Column) -> Column:
    """Name of a rank's level."""
    return F.create_map(*(F.lit(x) for name, n in LEVELS.items() for x in (n, name)))[rank]


def level_sql(rank: str) -> str:
    """The same in SQL."""
    return "CASE " + rank + " " + " ".join(f"WHEN {n} THEN '{name}'" for name, n in LEVELS.items()) + " END"
