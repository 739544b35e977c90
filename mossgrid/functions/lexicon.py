"""Word lists of the report scores. All are fixed values; their order is part of the rules."""

# Finding types: terms, severity, weight.
FINDINGS = [
    ("normal", ["normal", "unremarkable", "no abnormality", "clear", "no acute findings"], 0, 1.0),
    ("opacity", ["opacity", "opacities", "opacification", "density", "densities"], 2, 0.8),
    ("consolidation", ["consolidation", "consolidations", "consolidated", "airspace disease"], 3, 0.9),
    ("effusion", ["effusion", "effusions", "fluid", "pleural fluid"], 2, 0.8),
    ("pneumothorax", ["pneumothorax", "pneumothoraces", "collapsed lung", "air leak"], 4, 1.0),
    ("nodule", ["nodule", "nodules", "mass", "lesion", "tumor", "neoplasm"], 3, 0.9),
    ("fracture", ["fracture", "fractures", "fractured", "break", "broken"], 3, 0.9),
    ("cardiomegaly", ["cardiomegaly", "enlarged heart", "cardiac enlargement", "heart enlargement"], 2, 0.7),
    ("edema", ["edema", "edematous", "swelling", "pulmonary edema", "interstitial edema"], 2, 0.8),
    ("infiltrate", ["infiltrate", "infiltrates", "infiltration", "interstitial markings"], 2, 0.7),
    ("atelectasis", ["atelectasis", "atelectatic", "collapse", "volume loss"], 2, 0.7),
    ("pneumonia", ["pneumonia", "pneumonic", "infection", "infectious process"], 3, 0.9),
]

LOCATIONS = {
    "lung": ["lung", "lungs", "pulmonary", "pulmonic"],
    "lobe": ["lobe", "lobar"],
    "left": ["left", "left-sided", "left side"],
    "right": ["right", "right-sided", "right side"],
    "upper": ["upper", "superior", "apex", "apical", "apices"],
    "lower": ["lower", "inferior", "base", "basal", "basilar"],
    "middle": ["middle", "mid", "central", "lingula", "lingular"],
    "bilateral": ["bilateral", "both", "bibasilar", "bilaterally"],
    "unilateral": ["unilateral", "one side", "single"],
    "heart": ["heart", "cardiac", "cardiovascular", "pericardium"],
    "mediastinum": ["mediastinum", "mediastinal", "hilar", "hilum"],
    "pleura": ["pleura", "pleural", "pleural space"],
    "chest": ["chest", "thorax", "thoracic", "hemithorax"],
    "diaphragm": ["diaphragm", "diaphragmatic", "hemidiaphragm"],
    "costophrenic": ["costophrenic", "cp angle", "costophrenic angle"],
}

SEVERITIES = [
    ("mild", 0.3), ("minimal", 0.2), ("slight", 0.2), ("moderate", 0.6), ("marked", 0.8), ("severe", 1.0),
    ("extensive", 0.9), ("large", 0.8), ("small", 0.3), ("tiny", 0.1), ("trace", 0.1), ("prominent", 0.7),
    ("significant", 0.8),
]

TIMES = {
    "new": ["new", "newly", "recent", "acute"],
    "old": ["old", "chronic", "longstanding", "prior"],
    "unchanged": ["unchanged", "stable", "no change", "similar"],
    "improved": ["improved", "improving", "decreased", "resolving"],
    "worsened": ["worsened", "worsening", "increased", "progressed"],
}

CONFIDENCES = [
    ("possible", 0.3), ("probable", 0.7), ("likely", 0.7), ("unlikely", 0.2), ("questionable", 0.3), ("suspected", 0.6),
    ("concerning for", 0.7), ("suggestive of", 0.6), ("may represent", 0.5), ("cannot exclude", 0.4),
    ("differential includes", 0.5),
]

SIZES = [
    r"(\d+\.?\d*)\s*(cm|mm|millimeter|centimeter)",
    r"(\d+\.?\d*)\s*x\s*(\d+\.?\d*)\s*(cm|mm)",
    r"measuring\s*(\d+\.?\d*)\s*(cm|mm)",
    r"size\s*of\s*(\d+\.?\d*)\s*(cm|mm)",
]

NEGATIONS = [
    "no", "not", "without", "absent", "negative", "denied", "none", "free of", "rule out", "ruled out", "no evidence",
    "no signs",
]

SECTIONS = ["findings", "impression", "comparison", "technique", "recommendation"]

# Categories of the efficacy score, in order of priority, and what denies a term before it.
EFFICACY = {
    "critical": ["emergency", "urgent", "critical", "acute", "severe"],
    "abnormal": ["abnormal", "abnormality", "pathology", "disease", "disorder"],
    "normal": ["normal", "unremarkable", "clear", "no acute", "negative"],
    "uncertain": ["possible", "probable", "suspicious", "concerning", "question"],
}
EFFICACY_DENIALS = ["no ", "not ", "without"]

# Components of the report score and their weights.
WEIGHTS = {
    "entity_matching": 0.30, "location_accuracy": 0.20, "negation_handling": 0.15, "temporal_accuracy": 0.10,
    "measurement_accuracy": 0.10, "clinical_significance": 0.10, "structure_completeness": 0.05,
}
