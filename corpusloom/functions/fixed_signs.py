"""Patterns of critical signs, symptoms and conditions (letter case never counts)."""

CRITICAL_SIGNS = {
    "cardiac_arrest": [r"\b(?:arrêt\s+cardio(?:-| )?respiratoire|arrêt\s+cardiaque|acr)\b", r"\b(?:cardiac|cardiorespiratory|cardiopulmonary)\s+arrest\b"],
    "unconsciousness": [r"\b(?:inconscient(?:e)?|perte\s+de\s+connaissance|coma(?:teux|teuse)?|état\s+comateux)\b", r"\b(?:unconscious|loss\s+of\s+consciousness|comatose)\b"],
    "altered_consciousness": [
        r"\b(?:altération\s+de\s+la\s+conscience|conscience\s+altérée|troubles?\s+de\s+la\s+conscience|troubles?\s+de\s+vigilance|baisse\s+de\s+vigilance|stuporeux|stuporeuse|somnolent(?:e)?|somnolence|obnubilation|obnubilé(?:e)?)\b",
        r"\b(?:altered\s+(?:level\s+of\s+)?consciousness|decreased\s+(?:level\s+of\s+)?consciousness|impaired\s+consciousness|reduced\s+alertness|stuporous|drowsy|obtunded)\b",
    ],
    "confusion": [r"\b(?:confus(?:e)?|confusion|désorientation|désorienté(?:e)?)\b", r"\b(?:confused|confusion|disoriented|disorientation)\b"],
    "severe_respiratory_distress": [
        r"\b(?:détresse\s+respiratoire|insuffisance\s+respiratoire\s+aiguë|dyspnée\s+(?:majeure|sévère|intense)|signes?\s+de\s+lutte\s+respiratoire)\b",
        r"\b(?:severe\s+respiratory\s+distress|acute\s+respiratory\s+failure|severe\s+breathing\s+difficulty)\b",
    ],
    "cyanosis": [r"\b(?:cyanose|cyanosé(?:e)?|cyanose\s+centrale)\b", r"\b(?:cyanosis|cyanotic|central\s+cyanosis)\b"],
    "retractions": [
        r"\b(?:tirage(?:\s+(?:intercostal|sus[- ]sternal|sous[- ]costal))?|balancement\s+thoraco[- ]abdominal|battements?\s+des\s+ailes\s+du\s+nez)\b",
        r"\b(?:retractions?|intercostal\s+retractions?|chest\s+retractions?|nasal\s+flaring)\b",
    ],
    "orthopnea": [r"\b(?:orthopnée|orthopnee)\b", r"\borthopn(?:ea|oea)\b"],
    "massive_bleeding": [r"\b(?:hémorragie|hemorragie|saignement)\s+(?:massif|massive|abondant|abondante)\b", r"\b(?:massive|profuse|heavy)\s+(?:bleeding|hemorrhage|haemorrhage)\b"],
    "active_bleeding": [r"\b(?:saignement|hémorragie|hemorragie)\s+(?:actif|active|en\s+cours)\b", r"\bactive\s+(?:bleeding|hemorrhage|haemorrhage)\b"],
    "hematemesis": [r"\b(?:hématémèse|hematemese|vomissement(?:s)?\s+de\s+sang)\b", r"\b(?:hematemesis|haematemesis|vomiting\s+blood|bloody\s+vomit)\b"],
    "rectal_bleeding": [r"\b(?:rectorragie(?:s)?|méléna|melena|sang\s+dans\s+les\s+selles|selles\s+noires)\b", r"\b(?:rectal\s+bleeding|melena|melaena|blood\s+in\s+(?:the\s+)?stool|black\s+stool)\b"],
    "seizure": [
        r"\b(?:convulsion(?:s)?|épisode\s+convulsif|crise\s+(?:convulsive|comitiale|épileptique)|activité\s+convulsive|syndrome\s+convulsif)\b",
        r"\b(?:seizure(?:s)?|convulsion(?:s)?|convulsive\s+episode|epileptic\s+seizure|seizure\s+activity)\b",
    ],
    "shock": [r"\b(?:état\s+de\s+choc|choc\s+circulatoire|choc\s+hémodynamique)\b", r"\b(?:circulatory|hemodynamic|haemodynamic)\s+shock\b"],
    "motor_deficit": [
        r"\b(?:(?:déficit|deficit)\s+(?:moteur|neurologique)|hémiparésie|hemiparesie|hémiplégie|hemiplegie|parésie\s+brutale)\b",
        r"\b(?:(?:motor|neurologic|neurological)\s+deficit|hemiparesis|hemiplegia)\b",
    ],
    "aphagia": [r"\b(?:aphagie|impossibilité\s+d[’']avaler)\b", r"\b(?:aphagia|unable\s+to\s+swallow|inability\s+to\s+swallow)\b"],
    "hypersalivation": [r"\b(?:hypersialorrhée|hypersalivation|sialorrhée)\b", r"\b(?:hypersalivation|sialorrhea|sialorrhoea|excessive\s+salivation)\b"],
    "severe_pain": [
        r"\b(?:douleur(?:s)?\s+(?:intense|sévère|violente|insupportable)|douleur\s+brutale\s+et\s+intense|douleur\s+à\s+(?:9|10)\s*/\s*10)\b",
        r"\b(?:severe|intense|excruciating|unbearable)\s+pain\b",
    ],
    "agitation": [
        r"\b(?:agitation|agité(?:e)?|très\s+agité(?:e)?|agitation\s+psychomotrice|comportement\s+violent)\b",
        r"\b(?:agitation|agitated|markedly\s+agitated|psychomotor\s+agitation|violent\s+behavior)\b",
    ],
    "purpura": [r"\b(?:purpura|pétéchies?|petechies?|ecchymoses?)\b", r"\b(?:purpura|petechiae|petechial|ecchymoses?)\b"],
    "severe_headache": [r"\b(?:(?:céphalée|cephalee)s?\s+(?:intense|sévère|brutale|violente)|céphalée\s+en\s+coup\s+de\s+tonnerre)\b", r"\b(?:severe|sudden|intense|thunderclap)\s+headache\b"],
    "poor_tolerance": [r"\b(?:mauvaise\s+tolérance|mal\s+toléré(?:e)?)\b", r"\b(?:poor(?:ly)?\s+tolerated|poor\s+tolerance)\b"],
}
NO_CRITICAL_SIGNS = {
    "unconsciousness": [r"\b(?:sans|aucune|absence\s+de|pas\s+de)\s+(?:perte\s+de\s+connaissance|coma)\b", r"\b(?:no\s+loss\s+of\s+consciousness|remains?\s+conscious)\b"],
    "altered_consciousness": [
        r"\b(?:conscience\s+normale|conscience\s+claire|vigilance\s+normale|vigilance\s+conservée|sans\s+trouble\s+de\s+la\s+conscience|sans\s+trouble\s+de\s+vigilance)\b",
        r"\b(?:normal\s+consciousness|alert\s+and\s+oriented|fully\s+alert|normal\s+alertness)\b",
    ],
    "cyanosis": [r"\b(?:sans|aucune|absence\s+de|pas\s+de)\s+cyanose\b", r"\b(?:no|without)\s+cyanosis\b"],
    "seizure": [r"\b(?:sans|aucune|absence\s+de|pas\s+de)\s+(?:convulsions?|crise\s+convulsive|épisode\s+convulsif)\b", r"\b(?:no|without)\s+(?:seizures?|convulsions?|convulsive\s+episode)\b"],
    "motor_deficit": [r"\b(?:sans|aucun|absence\s+de|pas\s+de)\s+(?:déficit|deficit)\s+(?:moteur|neurologique)\b", r"\b(?:no|without)\s+(?:motor|neurological?)\s+deficit\b"],
    "agitation": [r"\b(?:sans|aucune|absence\s+d[’']?|pas\s+d[’']?)\s*agitation\b", r"\b(?:no|without)\s+agitation\b"],
}
SYMPTOM_SECTIONS = [
    r"\b(?:sympt[oô]mes?|signes?\s+fonctionnels?|motif(?:\s+de\s+consultation)?)\s*[:\-]\s*([^\n]+)",
    r"\b(?:symptoms?|presenting\s+complaint|chief\s+complaint)\s*[:\-]\s*([^\n]+)",
]
SYMPTOM_NARRATIVES = [
    r"\b(?:vient\s+)?consult(?:e|er|ait)\s+pour\s+([^.;:?!]{3,160})",
    r"\bse\s+plaint\s+(?:de|du|des|d[’'])\s*([^.;:?!]{3,160})",
    r"\b(?:est\s+)?(?:amené|amenée|admis|admise|hospitalisé|hospitalisée|adressé|adressée)\s+(?:aux\s+urgences\s+)?pour\s+([^.;:?!]{3,160})",
    r"\b(?:patient(?:e)?|malade|blessé(?:e)?|homme|femme|garçon|fille|enfant|nourrisson)\b[^.;:?!]{0,80}\b(?:présente|présentant|ayant|avec)\s+([^.;:?!]{3,160})",
    r"\b(?:patient|man|woman|boy|girl|child|infant)\b[^.;:?!]{0,80}\b(?:presents?|presented|with|experiencing|having)\s+(?:with\s+)?([^.;:?!]{3,160})",
    r"\b(?:presents?|presented|comes?|came)\s+(?:to\s+(?:the\s+)?(?:ED|emergency\s+department)\s+)?(?:with|for)\s+([^.;:?!]{3,160})",
    r"\bcomplains?\s+of\s+([^.;:?!]{3,160})",
]
NOT_SYMPTOMS = [
    r"^(?:la|le|les|un|une)?\s*(?:prise\s+en\s+charge|traitement|diagnostic|conduite\s+à\s+tenir|indication|contre-indication)\b",
    r"^(?:quel(?:le)?s?|laquelle|lesquelles|lequel|lesquels|parmi|which|what|who|why|how)\b",
]
CONDITIONS = [
    r"\b(?:diagnostic\s+de|diagnostiqué(?:e)?\s+(?:avec|pour)|atteint(?:e)?\s+de|présente\s+une?|présentant\s+une?|connu(?:e)?\s+pour)\s+([^.;:?!\n]{3,140})",
    r"\b(?:diagnosed\s+with|known\s+with|known\s+for|has\s+(?:a|an)?)\s+([^.;:?!\n]{3,140})",
]
NOT_CONDITIONS = [
    r"^(?:quel(?:le)?s?|lequel|laquelle|lesquels|lesquelles|which|what|who|why|how)\b",
    r"^(?:traitement|prise\s+en\s+charge|conduite\s+à\s+tenir|treatment|management)\b",
]
HISTORY_SECTIONS = [
    r"\b(?:antécédents?(?:\s+médicaux)?|atcd)\s*[:\-]\s*([^\n]+)",
    r"\b(?:medical\s+history|past\s+medical\s+history|pmh)\s*[:\-]\s*([^\n]+)",
]
HISTORY_NARRATIVES = [
    r"\bantécédents?\s+(?:de|notamment)\s+([^.;:?!]{3,180})",
    r"\b(?:est|était)\s+(?:suivi|suivie|traité|traitée)\s+pour\s+([^.;:?!]{3,180})",
    r"\b(?:history\s+of|known\s+history\s+of)\s+([^.;:?!]{3,180})",
]
NO_HISTORY = [
    r"\b(?:sans|aucun|aucune|absence\s+d[’']?)\s*antécédents?(?:\s+médicaux)?\b",
    r"\b(?:sans\s+antécédent\s+notable|aucun\s+antécédent\s+notable)\b",
    r"\b(?:no|without)\s+(?:significant\s+)?(?:medical\s+)?history\b",
]
DURATIONS = [
    r"\b(?:consulte|vient\s+consulter|se\s+plaint|présente)[^.;:?!]{0,140}\bdepuis\s+(\d+(?:[.,]\d+)?\s*(?:minutes?|heures?|jours?|semaines?|mois|ans?))\b",
    r"\b(?:depuis|évoluant\s+depuis|apparu(?:e)?\s+il\s+y\s+a)\s+(\d+(?:[.,]\d+)?\s*(?:minutes?|heures?|jours?|semaines?|mois|ans?))\b",
    r"\b(?:for|for\s+the\s+past|since)\s+(\d+(?:[.,]\d+)?\s*(?:minutes?|hours?|days?|weeks?|months?|years?))\b",
]
#: Minutes of a duration by how its unit begins.
MINUTES = [("min", 1), ("heur|hour|hr", 60), ("jour|day", 1440), ("sem|week", 10080), ("mois|month", 43830), ("an|year", 525960)]
EVOLUTIONS = {
    "worsening": [
        r"\b(?:sympt[oô]mes?|douleur|état|tableau)[^.;:?!]{0,80}(?:s[’']aggrave|s[’']est\s+aggravé|se\s+majore|aggravation)\b",
        r"\b(?:getting\s+worse|progressively\s+worse|condition\s+worsening|symptoms?\s+worsening)\b",
    ],
    "improving": [
        r"\b(?:sympt[oô]mes?|douleur|état|tableau)[^.;:?!]{0,80}(?:s[’']améliore|s[’']est\s+amélioré|régression|amélioration)\b",
        r"\b(?:getting\s+better|condition\s+improving|symptoms?\s+improving)\b",
    ],
    "stable": [r"\b(?:état|symptômes?|tableau)\s+(?:reste\s+)?(?:stable|stationnaire|inchangé)\b", r"\b(?:condition|symptoms?)\s+(?:remains?\s+)?(?:stable|unchanged)\b"],
    "sudden": [r"\b(?:début|apparition|survenue)\s+(?:brutal(?:e)?|soudain(?:e)?)\b", r"\b(?:sudden|abrupt)\s+onset\b"],
    "progressive": [r"\b(?:installation|apparition|évolution)\s+progressive(?:ment)?\b", r"\bgradual(?:ly)?\s+(?:onset|progression)\b"],
}
