"""Fixed values of knowledge extraction: patterns and word lists that results depend on; all are matched without regard to letter case."""

#: Intent of a question: the first pattern found anywhere in it.
INTENTS = [
    ("symptoms", r"\b(?:signs and symptoms|symptoms?|signs?|manifestations?|sympt[oô]mes?|signes?|manifestations?)\b"),
    ("treatment", r"\b(?:treatments?|what to do for|treated|therapy|therapies|traitements?|prise en charge|th[ée]rapies?)\b"),
    ("diagnosis", r"\b(?:diagnos(?:e|ed|is|ing|tic)|tests?|testing|diagnosti(?:c|quer|qu[ée])|examens?|tests?)\b"),
    ("complications", r"\b(?:complications?|complicated|compliqu[ée]e?s?)\b"),
    ("risk", r"\b(?:risk factors?|at risk|facteurs? de risques?|[àa] risque)\b"),
    ("causes", r"\b(?:causes?|caused by|etiology|causes?|caus[ée]e? par|[ée]tiologie)\b"),
    ("prognosis", r"\b(?:prognosis|outlook|survival|pronostic|survie|[ée]volution)\b"),
    ("prevalence", r"\b(?:how many people|how common|prevalence|frequency|combien de personnes|pr[ée]valence|fr[ée]quence)\b"),
    ("inheritance", r"\b(?:genetic|inherited|inheritance|hereditary|g[ée]n[ée]tique|h[ée]r[ée]ditaire|h[ée]r[ée]dit[ée])\b"),
    ("research", r"\b(?:research|clinical trials?|recherche|essais? cliniques?)\b"),
    ("prevention", r"\b(?:prevent|prevents|prevented|preventing|prevention|preventable|pr[ée]venir|pr[ée]vention|[ée]viter)\b"),
    ("information", r"\b(?:information about|informations? (?:sur|concernant|[àa] propos de))\b"),
    ("definition", r"^(?:what (?:is|are)(?:\s+\(are\))?|qu['’]est[- ]ce que|quels? sont|quelles? sont)\b"),
]
#: Subject of a question: the group of the first pattern that fits the whole of it.
SUBJECTS = [
    r"^what research \(or clinical trials\) is being done for (.+?)\s*\?$",
    r"^what are the (?:signs and )?symptoms (?:of|for) (.+?)\s*\?$",
    r"^what are the treatments for (.+?)\s*\?$",
    r"^what are the complications of (.+?)\s*\?$",
    r"^what are the genetic changes related to (.+?)\s*\?$",
    r"^what are the stages of (.+?)\s*\?$",
    r"^who is at risk for (.+?)\??\s*\?$",
    r"^how many people are affected by (.+?)\s*\?$",
    r"^what is the outlook for (.+?)\s*\?$",
    r"^how common is (.+?)\s*\?$",
    r"^how is hps diagnosed and treated for (.+?)\s*\?$",
    r"^how can the spread of (.+?) be prevented\s*\?$",
    r"^how can (.+?) be (?:treated|prevented)\s*\?$",
    r"^how to (?:diagnose|prevent) (.+?)\s*\?$",
    r"^what to do for (.+?)\s*\?$",
    r"^what causes (.+?)\s*\?$",
    r"^are there complications from (.+?)\s*\?$",
    r"^is (.+?) inherited\s*\?$",
    r"^do you have information about (.+?)\s*\??$",
    r"^what is \(are\) (.+?)\s*\?$",
    r"^what is (.+?)\s*\?$",
    r"^quels? sont les (?:principaux )?(?:signes|sympt[oô]mes) (?:de|du|des|d['’])\s*(.+?)\s*\?$",
    r"^quels? sont les (?:principaux )?facteurs? de risques? (?:de|du|des|d['’])\s*(.+?)\s*\?$",
    r"^quelles? sont les complications (?:de|du|des|d['’])\s*(.+?)\s*\?$",
    r"^quels? sont les traitements? (?:de|du|des|d['’])\s*(.+?)\s*\?$",
    r"^comment diagnostiquer (.+?)\s*\?$",
    r"^comment pr[ée]venir (.+?)\s*\?$",
    r"^quelles? sont les causes (?:de|du|des|d['’])\s*(.+?)\s*\?$",
    r"^quel est le pronostic (?:de|du|des|d['’])\s*(.+?)\s*\?$",
    r"^qu['’]est[- ]ce que (.+?)\s*\?$",
]
ANATOMY = {
    "fr": [
        "cœur", "poumon", "poumons", "cerveau", "foie", "rein", "reins", "estomac", "intestin", "colon", "pancréas", "rate", "thorax",
        "abdomen", "peau", "œil", "yeux", "oreille", "gorge", "larynx", "pharynx", "trachée", "bronches", "artère", "veine", "moelle épinière",
    ],
    "en": [
        "heart", "lung", "lungs", "brain", "liver", "kidney", "kidneys", "stomach", "intestine", "colon", "pancreas", "spleen", "chest",
        "abdomen", "skin", "eye", "eyes", "ear", "throat", "larynx", "pharynx", "trachea", "bronchi", "artery", "vein", "spinal cord",
        "bone", "bones", "cartilage", "blood", "nervous system", "white matter", "nerve", "nerves",
    ],
}
#: Where the options of a multiple-choice question begin, and the openings of its question line.
CHOICE_OPTION = r"(?m)^\s*(?:[A-E][.)]|[1-9][.)])\s+"
CHOICE_QUESTION = r"(?i)(?:quel(?:le|les|s)?\b|indiquez\b|choisissez\b|cochez\b|sélectionnez\b|which\b|choose\b|select\b)"
#: Flags that keep a record out of duplicate groups and out of conflict groups.
NOT_DUPLICATE = ["SCHEMA_UNSUPPORTED", "PRIVACY_EXCLUDED"]
NOT_CONFLICT = ["SCHEMA_UNSUPPORTED", "PRIVACY_EXCLUDED", "PII_REDACTION_FAILED"]
#: Terms too general to name a rule, and what shows the language of a term.
ALIAS_EXCLUDED = {
    "fr": [
        "douleur", "douleurs", "maladie", "infection", "traumatisme", "urgence", "patient", "symptome", "symptomes", "signe", "signes",
        "froid", "chaud", "rouge", "masse", "estomac", "intestins", "comportement", "enfant", "fièvre", "fievre",
    ],
    "en": [
        "pain", "disease", "infection", "trauma", "emergency", "patient", "symptom", "symptoms", "sign", "signs",
        "painful", "cold", "warm", "red", "mass", "stomach", "intestines", "behavior", "child", "fever",
    ],
}
LANGUAGE_MARKERS = {
    "fr": ["é", "è", "ê", "à", "â", "ç", "œ", "douleur", "fièvre", "membre", "grossesse", "saignement", "brûlure", "perte", "arrêt", "déficit", "courant", "domestique"],
    "en": [" pain", "fever", "blood", "bleeding", "loss", "heart", "pressure", "limb", "burn", "pregnancy", "shock", "seizure", "foreign body", "swelling"],
}
