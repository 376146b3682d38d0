"""Values that have to be exactly these for the results to be right."""

# Date formats named in epoch file banners -> Spark patterns.
DATE_FORMATS = {
    "dd.MM.yyyy": "dd.MM.yyyy",
    "M/d/yyyy": "M/d/yyyy",
}

# Long labels of the parameter codes.
LONG_LABELS = {
    "T": "VMU Threshold",
    "I": "Up/Down window size (mins)",
    "M": "Allowed #spikes in window",
    "AT": "Minimum spike threshold (counts)",
    "MPL": "Minimum interval (mins)",
    "ST": "Allowed #spikes",
    "SS": "Maximum spike threshold (counts)",
    "MWL": "Window size (mins)",
    "WST": "Allowed #spikes in window",
    "MW": "Minimum interval (mins)",
    "WO": "Window overlap",
    "StdT": "Std. threshold (mg)",
    "StdA": "Std. min. #axes",
    "VT": "Value threshold (mg)",
    "VA": "Value min. #axes",
    "VM": "Use VMU",
}

# Significance marks by upper bound of p.
SIGNIFICANCE_MARKS = {
    0.001: r"$ \ddag$",
    0.01: r"$ \dag$",
    0.05: r"$ *$",
}

# Parameter spaces of the exhaustive searches.
HECHT_SPACE = {
    "t": [1, 5, 10, 15, 20, 25, 30, 35, 40, 45, 50],
    "i": list(range(5, 101, 5)),
    "m": [1, 2, 3, 4, 5],
}
TROIANO_SPACE = {
    "at": [0, 25, 50, 75, 100],
    "mpl": [1, 20, 40, 60, 80, 100, 120, 140, 160, 180, 200],
    "st": [1, 2, 3, 4, 5, 6, 7, 8, 9, 10],
    "ss": [1, 25, 50, 75, 100, 125, 150, 175, 200],
    "vm": [True, False],
}
CHOI_SPACE = {
    "at": [0, 25, 50, 75, 100],
    "mpl": [30, 60, 90, 120, 150, 180, 210],
    "st": [1, 2, 3, 4, 5],
    "mwl": [10, 20, 30, 40, 50, 60],
    "wst": [0, 1, 2, 3, 4],
    "vm": [True, False],
}
HEES_SPACE = {
    "mw": [15, 30, 45, 60, 75, 90, 105, 120, 135],
    "wo": [1],
    "st": [2, 3, 4, 5, 6, 7, 8],
    "sa": [1, 2, 3],
    "vt": [1, 5, 10, 15, 20, 25, 50, 75, 100],
    "va": [1, 2, 3],
}
EDGE_DECISION_SPACE = {
    "edge": [True, False],
    "op": ["or", "and"],
    "distance": [1, 2, 3, 4, 5],
}
BASELINE_SPACE = {
    "std": [0.004, 0.005, 0.006, 0.007],
    "length": [15, 30, 45, 60, 75, 90, 105, 120],
}

# Published defaults.
HECHT_DEFAULT = {"t": 5, "i": 20, "m": 2}
TROIANO_DEFAULT = {"at": 0, "mpl": 60, "st": 2, "ss": 100, "vm": False}
CHOI_DEFAULT = {"at": 0, "mpl": 90, "st": 2, "mwl": 30, "wst": 0, "vm": False}
HEES_DEFAULT = {"mw": 60, "wo": 15, "st": 3, "sa": 2, "vt": 50, "va": 2}

# Metres per second squared to g.
MS2_TO_G = 0.101972

# Labels of the lines above the data in an epoch file.
EPOCH_HEADER_LABELS = [
    "Serial Number", "Start Time", "Start Date", "Epoch Period (hh:mm:ss)", "Download Time",
    "Download Date", "Current Memory Address", "Current Battery Voltage",
]

# First line of the data of an epoch file -> position of the first count column.
EPOCH_LAYOUTS = {
    "axis1,axis2,axis3,steps,subjectname": 0,
    "axis1,axis2,axis3,steps": 0,
    "timestamp,filename,epochlengthinseconds,serialnumber,axis1,axis2,axis3,steps,lux,vectormagnitude,capsense,"
    "inclineoff,inclinestanding,inclinesitting,inclinelying,gender,subjectname": 4,
}

# Subjects left out for invalid recordings.
EXCLUDED_SUBJECTS = [
    "90013013", "90022619", "90097429", "90107724", "90265628", "90277429", "90352827", "90358126",
    "90359935", "90551323", "90631928", "90821020", "90884635", "90936734", "90952429", "92108626",
    "92280425", "92327831", "92355428", "92504323", "93208931", "90165829",
]

# Episodes whose predicted label is flipped, subject -> counters.
LABEL_CORRECTIONS = {
    "90086831": [0, 1, 2, 3, 4, 5, 6, 7],
    "91864028": [38],
    "90974029": [4],
    "90173929": [0],
    "90187631": [0],
    "90475732": [0],
    "90656834": [2],
    "90897538": [25],
    "92460728": [0],
    "92987439": [1],
    "90021214": [2],
    "90015722": [4, 8],
    "90070016": [23],
    "90089632": [25],
    "90110920": [45, 46],
    "90121316": [18],
    "90151521": [7],
    "90172019": [4],
    "90181524": [17],
    "90219930": [0],
    "90232925": [1],
    "90239124": [24],
    "90242017": [8, 9, 10, 11, 12, 13, 14, 15, 16],
    "90244423": [37],
    "90245424": [2],
    "90249024": [0, 1],
    "90261927": [0],
    "90279027": [0],
    "90287430": [0],
    "90319123": [12, 14],
    "90334524": [11],
    "90345122": [0, 1],
    "90359733": [35, 36],
    "90362525": [0],
    "90364224": [0],
    "90389837": [10, 11],
    "90392124": [0, 1, 13],
    "90409325": [0],
    "90413825": [11],
    "90414422": [15],
    "90423321": [18, 20],
    "90447125": [0, 1],
    "90470020": [2],
    "90537529": [0, 1],
    "90543223": [1],
    "90558633": [24],
    "90590326": [1],
    "90681428": [20],
    "90683733": [20],
    "90730625": [16],
    "90819330": [20],
    "90923225": [1, 3],
    "90925328": [20],
    "90984939": [0],
    "91187935": [14],
    "91633729": [14],
    "91643427": [11],
    "92150421": [13, 15],
    "92191527": [19],
    "92237730": [18],
    "92680530": [3],
    "93192832": [20],
    "93214322": [5],
    "93222624": [23],
    "93324223": [4],
    "93328126": [1],
}

# Episodes merged by hand, subject -> first and last counter.
MERGED_EPISODES = {
    "90042823": (6, 7),
    "90086831": (0, 7),
    "90173929": (0, 1),
    "90233320": (8, 9),
    "90301821": (0, 3),
    "90341522": (40, 41),
    "90446124": (11, 12),
    "90486330": (6, 7),
    "90489737": (29, 31),
    "90902626": (10, 11),
    "91008321": (23, 24),
    "91845330": (8, 9),
    "92198837": (7, 9),
    "92723932": (32, 33),
    "92987439": (1, 2),
    "90021214": (2, 3),
    "90015722": (4, 5),
    "90089632": (24, 25),
    "90110920": (45, 46),
    "90172019": (4, 5),
    "90181524": (16, 17),
    "90232925": (1, 2),
    "90239124": (23, 24),
    "90242017": (8, 18),
    "90287430": (0, 1),
    "90319123": (11, 14),
    "90345122": (0, 1),
    "90359733": (35, 37),
    "90389837": (10, 11),
    "90413825": (11, 12),
    "90423321": (18, 20),
    "90537529": (0, 1),
    "90681428": (19, 20),
    "90923225": (0, 2),
    "90925328": (20, 21),
    "91643427": (11, 12),
    "92150421": (14, 15),
    "92191527": (18, 19),
    "93214322": (5, 6),
    "93324223": (2, 4),
}
