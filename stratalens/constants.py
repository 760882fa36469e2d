"""Values that have to stay as they are for results to be comparable."""

# The benchmark tasks, by family.
TASKS_BY_TYPE = {
    "pair_classification": [
        "SprintDuplicateQuestions",
        "TwitterSemEval2015",
        "TwitterURLCorpus",
    ],
    "classification": [
        "AmazonCounterfactualClassification",
        "AmazonReviewsClassification",
        "Banking77Classification",
        "EmotionClassification",
        "MTOPDomainClassification",
        "MTOPIntentClassification",
        "MassiveIntentClassification",
        "MassiveScenarioClassification",
        "ToxicConversationsClassification",
        "TweetSentimentExtractionClassification",
    ],
    "clustering": [
        "ArxivClusteringS2S",
        "BiorxivClusteringS2S",
        "MedrxivClusteringS2S",
        "RedditClustering",
        "StackExchangeClustering",
        "TwentyNewsgroupsClustering",
    ],
    "reranking": [
        "AskUbuntuDupQuestions",
        "MindSmallReranking",
        "SciDocsRR",
        "StackOverflowDupQuestions",
    ],
    "sts": [
        "BIOSSES",
        "SICK-R",
        "STS12",
        "STS13",
        "STS14",
        "STS15",
        "STS16",
        "STS17",
        "STSBenchmark",
    ],
}

# Checkpoint steps saved early in training, the regular stride and the last step.
EARLY_STEPS = [0, 1, 2, 4, 8, 16, 32, 64, 128, 256, 512]
STEP_STRIDE = 1000
LAST_STEP = 143000

# Transformer layers per model size.
LAYERS_BY_SIZE = {"14m": 6, "70m": 6, "410m": 24}

# Model id parts.
MODEL_ORG = "EleutherAI"
MODEL_PREFIX = "pythia-"

# The statistics kept per arm, the four used as bandit context first.
CONTEXT_METRICS = ["prompt_entropy", "dataset_entropy", "curvature", "effective_rank"]
METRICS = CONTEXT_METRICS + [
    "logdet_covariance",
    "anisotropy",
    "spectral_norm",
    "mean_pairwise_cosine",
]

# Layers the metric report looks at.
KEY_LAYERS = [0, 1, 2, 3, 5, 10, 15, 20, 22, 23]
EARLY_LAYERS = [0, 1, 2, 3]
LATE_LAYERS = [20, 21, 22, 23]

# Work statuses.
STATUSES = ["pending", "processing", "completed", "failed"]

# Text columns in the order they are looked for.
CORPUS_COLUMNS = ["text", "sentence", "sentence1", "sentence2", "sentences", "input", "query"]
RECORD_KEYS = ["text", "sentence", "sentence1", "sentence2", "sentences", "input"]

# Numerical guards.
EPS = 1e-10
COSINE_EPS = 1e-12
HISTOGRAM_BINS = 50
UNSEEN_ARM_SCORE = 1e6
