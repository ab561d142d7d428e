"""Patterns of the twelve fields of medical knowledge (letter case never counts)."""

FIELDS = {
    "conditions": [
        r"\b(?:diagnostic\s+de|diagnostiqué(?:e)?\s+(?:avec|pour)|atteint(?:e)?\s+de|souffre\s+de|maladie\s+de|antécédents?\s+de|connu(?:e)?\s+pour)\s+([^.;:?!\n]{3,140})",
        r"\b(?:diagnosed\s+with|diagnosis\s+of|suffers?\s+from|history\s+of|known\s+for|known\s+with|medical\s+history\s+of)\s+([^.;:?!\n]{3,140})",
        r"\b(?:has|had)\s+(?:a|an)?\s*((?:acute|chronic|metastatic|recurrent|severe|advanced|stage\s+[ivx0-9]+|type\s+[12])\s+[^.;:?!\n]{2,100})",
        r"\b([A-Z][^.;:?!\n]{2,100}?)\s+(?:is|are)\s+(?:a|an)\s+(?:rare\s+)?(?:genetic\s+|inherited\s+|chronic\s+|acute\s+)?(?:disorder|disease|condition|syndrome)\b",
        r"\b(?:condition|disease|disorder|syndrome)\s+(?:called|known\s+as)\s+([^.;:?!\n]{3,100})",
    ],
    "symptoms": [
        r"\b(?:sympt[oô]mes?|signes?\s+cliniques?|manifestations?\s+cliniques?)\s*[:\-]\s*([^.;?!\n]{3,180})",
        r"\b(?:symptoms?|clinical\s+signs?|clinical\s+manifestations?)\s*[:\-]\s*([^.;?!\n]{3,180})",
        r"\b(?:présente|présentant|se\s+plaint\s+de)\s+([^.;?!\n]{3,160})",
        r"\b(?:presents?|presented)\s+with\s+([^.;?!\n]{3,160})",
        r"\b(?:complains?\s+of|experiencing|experienced)\s+([^.;?!\n]{3,160})",
        r"\b(?:symptoms?|signs?|manifestations?)\s+(?:include|includes|may\s+include|can\s+include|often\s+include|typically\s+include|are)\s+([^.;?!\n]{3,200})",
        r"\b(?:common|typical|possible|early|initial|major)\s+(?:symptoms?|signs?)\s+(?:include|are)\s+([^.;?!\n]{3,200})",
        r"\b(?:patients?|people|individuals|children|adults)\s+(?:with\s+[^.;?!\n]{2,100}\s+)?(?:may|can|often|commonly|typically)\s+(?:have|develop|experience|show|present\s+with)\s+([^.;?!\n]{3,180})",
        r"\b(?:affected\s+(?:people|individuals|patients|children))\s+(?:may|can|often|commonly|typically)?\s*(?:have|develop|experience|show)\s+([^.;?!\n]{3,180})",
        r"\b(?:caractérisé(?:e)?\s+par|associé(?:e)?\s+à)\s+([^.;?!\n]{3,160})",
        r"\b(?:characterized\s+by|associated\s+with)\s+([^.;?!\n]{3,160})",
    ],
    "medications": [
        r"\b(?:traité(?:e)?\s+par|traitement\s+par|reçoit|recevant|administration\s+de|prescription\s+de|prend|sous)\s+([^.;:?!\n]{2,120})",
        r"\b(?:treated\s+with|receives?|receiving|administered|prescribed|taking|started\s+on|maintained\s+on|currently\s+on)\s+([^.;:?!\n]{2,120})",
        r"\bon\s+([^.;:?!\n]{2,80})\s+(?:therapy|treatment|medication|medications)\b",
        r"\b(?:medications?|drugs?)\s+(?:such\s+as|include|includes)\s+([^.;?!\n]{3,160})",
        r"\b(?:may|can)\s+be\s+(?:treated|managed)\s+with\s+([^.;?!\n]{3,160})",
    ],
    "treatments": [
        r"\b(?:traitement|prise\s+en\s+charge|thérapie|therapie)\s*(?:recommandé(?:e)?|indiqué(?:e)?|de\s+choix|consiste\s+en|comprend|inclut|:)?\s*([^.;?!\n]{3,160})",
        r"\b(?:treatment|management|therapy)\s*(?:recommended|indicated|of\s+choice|consists?\s+of|includes?|may\s+include|can\s+include|:)\s*([^.;?!\n]{3,180})",
        r"\b(?:managed\s+with|management\s+with)\s+([^.;?!\n]{3,140})",
        r"\b(?:treatments?|therapies)\s+(?:include|includes|may\s+include|can\s+include)\s+([^.;?!\n]{3,180})",
        r"\b(?:treatment|management)\s+(?:usually|typically|often)?\s*(?:involves?|requires?)\s+([^.;?!\n]{3,180})",
        r"\b(?:treated|managed)\s+(?:by|with|using)\s+([^.;?!\n]{3,160})",
        r"\b(?:there\s+is\s+)?no\s+(?:specific\s+)?(?:treatment|therapy|cure)\b([^.;?!\n]{0,120})",
    ],
    "procedures": [
        r"\b(?:intervention|procédure|procedure|chirurgie|opération|operation)\s*[:\-]?\s*([^.;?!\n]{3,140})",
        r"\b(?:surgery|procedure|operation|intervention)\s*[:\-]?\s*([^.;?!\n]{3,140})",
        r"\b(?:underwent|undergoing|scheduled\s+for)\s+([^.;?!\n]{3,140})",
        r"\b(?:a\s+subi|doit\s+subir|prévu(?:e)?\s+pour)\s+([^.;?!\n]{3,140})",
        r"\b(?:procedures?|surgical\s+procedures?)\s+(?:include|includes|may\s+include)\s+([^.;?!\n]{3,180})",
    ],
    "laboratory_findings": [
        r"\b(?:biologie|bilan\s+biologique|analyse\s+de\s+sang|laboratoire|résultats?\s+biologiques?)\s*[:\-]\s*([^.;?!\n]{3,220})",
        r"\b(?:laboratory|lab\s+results?|blood\s+tests?|laboratory\s+findings?)\s*[:\-]\s*([^.;?!\n]{3,220})",
        r"\b(?:blood\s+tests?|laboratory\s+tests?)\s+(?:show|shows|showed|reveal|reveals|may\s+show)\s+([^.;?!\n]{3,180})",
        r"\b(?:shows?|showed|reveals?|revealed|demonstrates?)\s+((?:elevated|decreased|low|high|increased|reduced|abnormal)\s+[^.;?!\n]{2,120})",
        r"\b(?:montre|montrait|révèle|revele|objective)\s+((?:une?\s+)?(?:augmentation|diminution|élévation|elevation|baisse)\s+[^.;?!\n]{2,120})",
    ],
    "imaging_findings": [
        r"\b(?:radiographie|scanner|TDM|IRM|échographie|echographie|imagerie)\s*(?:montre|révèle|revele|objective|:|-)?\s*([^.;?!\n]{3,180})",
        r"\b(?:x[- ]?ray|CT(?:\s+scan)?|MRI|ultrasound|imaging)\s*(?:shows?|showed|reveals?|revealed|demonstrates?|may\s+show|can\s+show|:|-)\s*([^.;?!\n]{3,180})",
        r"\b(?:imaging|x[- ]?rays?|CT(?:\s+scans?)?|MRI|ultrasound)\s+(?:may|can|often)?\s*(?:show|reveal|demonstrate)\s+([^.;?!\n]{3,180})",
    ],
    "diagnostic_tests": [
        r"\b(?:test|examen|bilan)\s+(?:diagnostique|diagnostic|de\s+confirmation|confirmatoire)\s*[:\-]?\s*([^.;?!\n]{3,140})",
        r"\b(?:confirmé(?:e)?\s+par|diagnostiqué(?:e)?\s+par)\s+([^.;?!\n]{3,120})",
        r"\b(?:diagnostic\s+test|confirmatory\s+test|workup)\s*[:\-]?\s*([^.;?!\n]{3,140})",
        r"\b(?:confirmed\s+by|diagnosed\s+by|diagnosed\s+with)\s+([^.;?!\n]{3,140})",
        r"\b(?:diagnosis|diagnosing\s+[^.;?!\n]{2,80})\s+(?:involves?|requires?|includes?|is\s+based\s+on)\s+([^.;?!\n]{3,180})",
        r"\b(?:tests?|testing|examinations?)\s+(?:used\s+to|can\s+help|may\s+help)\s+(?:diagnose|confirm|detect)\s+([^.;?!\n]{3,160})",
        r"\b(?:blood\s+tests?|genetic\s+testing|biopsy|electrocardiogram|ECG|EKG|CT(?:\s+scan)?|MRI|ultrasound)\s+(?:may|can|will|is|are)\s+(?:be\s+)?(?:used|performed|done|ordered)\b([^.;?!\n]{0,120})",
    ],
    "complications": [
        r"\b(?:complication(?:s)?|compliqué(?:e)?\s+de|évolue\s+vers|ayant\s+entraîné|entraînant)\s+([^.;:?!\n]{3,140})",
        r"\b(?:complication(?:s)?|complicated\s+by|progresses?\s+to|resulting\s+in|leading\s+to)\s+([^.;:?!\n]{3,160})",
        r"\b(?:developed|develops)\s+((?:acute|severe|progressive|new(?:ly)?[- ]onset)\s+[^.;:?!\n]{2,120})",
        r"\b(?:complications?|possible\s+complications?)\s+(?:include|includes|may\s+include|can\s+include|are)\s+([^.;?!\n]{3,180})",
        r"\b(?:may|can)\s+(?:lead\s+to|result\s+in|cause)\s+([^.;?!\n]{3,160})",
    ],
    "risk_factors": [
        r"\b(?:facteurs?\s+de\s+risque|terrain\s+à\s+risque|risque\s+accru\s+lié\s+à)\s*[:\-]?\s*([^.;?!\n]{3,180})",
        r"\b(?:risk\s+factors?|high[- ]risk\s+features?|increased\s+risk\s+due\s+to)\s*[:\-]?\s*([^.;?!\n]{3,180})",
        r"\b(?:risk\s+factors?)\s+(?:include|includes|may\s+include|are)\s+([^.;?!\n]{3,180})",
        r"\b(?:people|patients|individuals)\s+(?:who|with)\s+([^.;?!\n]{3,140})\s+(?:are|have)\s+(?:at\s+)?(?:an?\s+)?(?:increased|higher|greater)?\s*risk\b",
        r"\b(?:increases?|raises?)\s+(?:the\s+)?risk\s+of\s+([^.;?!\n]{3,140})",
    ],
    "pathogens": [
        r"\b(?:infection\s+(?:par|à)|causé(?:e)?\s+par|germe\s+responsable|agent\s+responsable)\s+([^.;:?!\n]{2,100})",
        r"\b(?:infection\s+(?:with|by)|caused\s+by|causative\s+(?:organism|pathogen|agent))\s+([^.;:?!\n]{2,120})",
        r"\b(?:bacterium|bacteria|virus|fungus|fungi|parasite)\s+(?:called|known\s+as)\s+([^.;:?!\n]{2,100})",
    ],
    "causes": [
        r"\b(?:due\s+to|secondary\s+to|caused\s+by|attributed\s+to)\s+([^.;:?!\n]{3,160})",
        r"\b(?:dû(?:e)?\s+à|du(?:e)?\s+à|secondaire\s+à|causé(?:e)?\s+par|attribué(?:e)?\s+à)\s+([^.;:?!\n]{3,160})",
        r"\b(?:cause|causes)\s+(?:include|includes|may\s+include|are)\s+([^.;?!\n]{3,180})",
        r"\b(?:results?\s+from|arises?\s+from)\s+([^.;?!\n]{3,160})",
        r"\b(?:mutation|mutations|changes?)\s+in\s+([^.;?!\n]{3,120})",
    ],
}
#: Where a value turns into a new question, and values that say nothing.
QUESTION_TAIL = r"\s*,?\s*\b(?:which\s+of\s+the\s+following|which|what|who|why|how|quel(?:le)?s?|lequel|laquelle|parmi\s+les|quelle\s+est)\b.*$"
NOT_VALUES = [
    r"^(?:which|what|who|why|how|quel(?:le)?s?|lequel|laquelle|parmi)\b",
    r"^(?:this|that|these|those|ceci|cela|cette\s+condition|these\s+conditions)$",
    r"^(?:treatment|management|diagnosis|traitement|prise\s+en\s+charge|diagnostic)$",
]
#: An item before its frequency (letter case counts).
FREQUENCY_ITEM = r"([A-Za-z][A-Za-z /'-]{2,80}?)\s+(?:\d+(?:\.\d+)?%|\d+/\d+)"
