"""Fixed values that results depend on: word lists, weights, thresholds and patterns."""

STOPWORDS = "a an and are as at be by for from in is it of on or that the to with".split()
JUDGE_STOPWORDS = [w for w in STOPWORDS if w != "that"]
PHRASE_STOPWORDS = "a an and are be can does for from how if in is of on or patient patients the to what when with".split()

LABELS = {
    "yes": "yes y true correct supported affirmative".split(),
    "no": "no n false incorrect unsupported negative".split(),
    "maybe": "maybe uncertain unknown inconclusive possibly possible".split(),
}
POSITIVE_CUES = "beneficial effective helps improves indicated prevents recommended reduces safe supports treats".split()
NEGATIVE_CUES = ["avoid", "contraindicated", "harmful", "increases risk", "not", "unsafe", "worsens"]

LIFE_CRITICAL = ["contraindicated", "contraindication", "unsafe", "fatal", "life-threatening", "bleeding", "hemorrhage", "pregnancy", "pregnant", "child", "children", "pediatric", "dose", "dosage", "mg", "mcg", "g/day", "avoid", "warning", "toxicity", "overdose", "renal failure", "hepatic failure"]
TEMPORAL = "acute chronic today tomorrow week month year duration".split()
POPULATION = "adult adults child children pediatric elderly geriatric pregnant pregnancy male female".split()
LOGICAL = ["because", "therefore", "thus", "hence", "so that", "mechanism", "pathway"]
JUDGE_NEGATIVE = "no not never without contraindicated avoid unsafe worsen worsens worsened increase increases risk adverse harmful".split()
JUDGE_POSITIVE = "safe effective recommended beneficial indicated improves reduces prevents treats helps".split()
AUDIT_LIFE_CRITICAL = "dose dosage mg mcg contraindication contraindicated interaction ddi bleeding hemorrhage safe unsafe avoid".split()
AUDIT_NEGATIVE = "no not never without avoid unsafe contraindicated risk adverse".split()
AUDIT_POSITIVE = "safe recommended effective beneficial indicated reduces prevents treats".split()
AUDIT_TYPES = {
    "sourceattribution": ["pmid:", "edge:", "edgeid", "edge_id:"],
    "lifecritical": ["dose", "dosage", "mg", "mcg", "contraindication", "contraindicated", "interaction", "ddi"],
    "logical": ["because", "therefore", "thus", "hence", "so "],
    "temporal": ["today", "tomorrow", "week", "month", "year", "acute", "chronic"],
    "population": ["adult", "child", "children", "pediatric", "pregnant", "elderly", "female", "male"],
    "contextual": ["for ", "in ", "with ", "without "],
}
NEGATIVE_RELATIONS = ["contraindication", "disease_phenotype_negative", "anatomy_protein_absent"]
NEGATIVE_DISPLAY = ["contra", "risk", "adverse", "avoid"]

CLASH_NEGATIVE = ["no benefit", "no evidence", "not recommended", "not effective", "did not", "does not", "fails to", "contraindicated", "avoid", "worsens", "increases risk"]
CLASH_POSITIVE = ["recommended", "effective", "prevents", "reduces", "treats", "improves", "supports", "beneficial", "indicated"]
ABBREVIATIONS = {
    "acei": "angiotensin converting enzyme inhibitor", "af": "atrial fibrillation", "aki": "acute kidney injury", "arb": "angiotensin receptor blocker", "bid": "twice daily",
    "cabg": "coronary artery bypass grafting", "cad": "coronary artery disease", "ckd": "chronic kidney disease", "copd": "chronic obstructive pulmonary disease", "dm": "diabetes mellitus",
    "dvt": "deep vein thrombosis", "hf": "heart failure", "htn": "hypertension", "mi": "myocardial infarction", "nsaid": "nonsteroidal anti inflammatory drug", "pe": "pulmonary embolism",
    "qd": "once daily", "ra": "rheumatoid arthritis", "tid": "three times daily",
}

QUESTION_PATTERNS = {
    "drug_interaction": ["interaction", "interact", "contraindicated", "combine", "co-administer", "coadminister"],
    "dosage": ["dose", "dosage", "mg", "mcg", "titrate", "how much"],
    "diagnosis": ["diagnosis", "diagnose", "differential", "most likely", "presents with", "likely condition"],
    "etiology": ["cause", "causes", "caused by", "etiology", "why does", "mechanism"],
}
ROUTES = {
    "drug_interaction": ["drug_drug", "drugdrug", "contraindication", "drug_protein", "indication", "off-label use", "drug_effect"],
    "dosage": ["contraindication", "indication", "drug_protein", "pharmacologic_class", "drug_effect"],
    "diagnosis": ["disease_disease", "disease_protein", "disease_symptom", "disease_phenotype_positive", "disease_phenotype_negative", "phenotype_phenotype"],
    "etiology": ["disease_protein", "gene_disease", "anatomy_disease", "exposure_disease", "exposure_protein", "anatomy_protein_present", "anatomy_protein_absent"],
    "other": ["contraindication", "indication", "drug_drug", "drug_protein", "drug_effect", "disease_disease", "disease_protein", "disease_phenotype_positive"],
}
FAMILIES = {"disease symptom": ["disease_phenotype_positive", "disease_phenotype_negative"], "gene disease": ["disease_protein"]}
TOKEN_SYNONYMS = {"gene": "protein", "symptom": "phenotype"}
QUESTION_TYPE_NAMES = {"drug interaction": "drug_interaction", "drug-interaction": "drug_interaction", "drug_interaction": "drug_interaction", "ddi": "drug_interaction", "dosage": "dosage", "dose": "dosage", "diagnosis": "diagnosis", "dx": "diagnosis", "etiology": "etiology", "aetiology": "etiology", "factoid": "factoid", "other": "other"}
PUZZLES = {0: "drug_interaction", 1: "diagnosis", 2: "dosage", 3: "etiology", 4: "other"}

RELIABILITY = {"drugbank": 0.95, "drugcentral": 0.94, "guidetopharmacology": 0.93, "omim": 0.90, "disgenet": 0.88, "reactome": 0.86, "go": 0.84, "hpo": 0.83, "ctd": 0.80, "primekg": 0.78, "pubmed": 0.75}
OTHER_RELIABILITY = 0.70
ENTITY_TYPES = {"disease": "disease", "drug": "drug", "protein": "protein", "phenotype": "symptom", "symptom": "symptom", "anatomy": "anatomy"}
NO_EVIDENCE = ["", "n/a", "na", "n.a.", "none", "null", "nil", "unknown", "not_applicable", "not applicable", "not-applicable"]

TOP_EDGES, ALPHA = 200, 0.85
NODE_WEIGHT, SOURCE_WEIGHT, SEED_BONUS = 0.45, 0.10, 0.05
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
BM25_SHARE, DENSE_SHARE, CROSS_SHARE = 0.4, 0.3, 0.3
TOP_PASSAGES, RERANK_POOL = 5, 50
REL_TOL, ABS_TOL = 0.05, 0.5
LEXICAL_SUPPORT = 0.35
UNITS = "mcg|mg|g|kg|ml|l|units|%|mmhg|mmol/?l|mg/?dl|g/?day|mg/?day|mcg/?day"
