"""Fixed values that result files, label texts and reports must share with the tools they are exchanged with."""

# Folder name to task name of saved datasets (two folders mean the same task).
TASK_FOLDERS = {
    "binary_classification": "Binary classification",
    "multiclass_classification": "Multiclass classification",
    "regression": "Regression",
    "anomaly": "Anomaly detection",
    "anomaly_detection": "Anomaly detection",
}

# Texts that stand for true and false in label columns.
TRUE_TEXTS = ["true", "1", "yes"]
FALSE_TEXTS = ["false", "0", "no"]

# Library labels of result files; a file belongs to the first one if its name contains the word.
LIBRARIES = ["CapyMOA", "River"]
LIBRARY_WORD = "capymoa"
GENERATED_PREFIX = "benchmark_comparison"

# Accepted column names for time and memory, first match wins.
TIME_NAMES = ["Time in s", "Time_s", "time_s", "time", "elapsed_s", "Elapsed s", "Time in S"]
MEMORY_NAMES = [
    "Memory in Mb", "Memory in MB", "memory in mb", "Memory_In_Mb", "Memory_MB", "memory_mb", "memory", "RSS_MB",
    "rss_mb", "MemoryMB",
]

# Short names of metrics in reports.
METRIC_ALIASES = {
    "acc": "Accuracy",
    "accuracy": "Accuracy",
    "f1": "F1",
    "macro_f1": "MacroF1",
    "macrof1": "MacroF1",
    "micro_f1": "MicroF1",
    "microf1": "MicroF1",
    "time": "time_s",
    "runtime": "time_s",
    "memory": "memory_mb",
}

# Dataset names that reports show in mixed case.
DATASET_NAMES = {"chickweights": "ChickWeights", "trumpapproval": "TrumpApproval"}

# Model names of one library and the common name reports use.
MODEL_NAMES = {
    "AdaptiveRandomForestClassifier": "Adaptive Random Forest",
    "HoeffdingTree": "Hoeffding Tree",
    "HoeffdingAdaptiveTree": "Hoeffding Adaptive Tree",
    "NaiveBayes": "Naive Bayes",
    "KNN": "k-Nearest Neighbors",
    "StreamingRandomPatches": "Streaming Random Patches",
    "OnlineAdwinBagging": "ADWIN Bagging",
    "LeveragingBagging": "Leveraging Bagging",
    "OnlineBagging": "Bagging",
    "OzaBoost": "OzaBoost (CapyMOA)",
    "SGDClassifier": "Logistic regression",
    "PassiveAggressiveClassifier": "Passive-Aggressive Classifier",
}

# Models that the multiclass report keeps, per library (matched case-sensitively).
MULTICLASS_MODELS = {
    "River": [
        "Hoeffding Adaptive Tree", "Hoeffding Tree", "k-Nearest Neighbors", "Bagging", "Leveraging Bagging",
        "ADWIN Bagging", "Naive Bayes", "AdaBoost", "[baseline] Last Class",
    ],
    "CapyMOA": [
        "Hoeffding Adaptive Tree", "Hoeffding Tree", "k-Nearest Neighbors", "Bagging", "Leveraging Bagging",
        "ADWIN Bagging", "Naive Bayes", "OnlineSmoothBoost", "SAMKNN", "Streaming Random Patches", "WeightedkNN",
        "[baseline] Last Class",
    ],
}
