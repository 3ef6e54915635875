"""Parameters and fixed values.

Everything that must equal the behaviour being reproduced lives here, in one
place, in natural order.  Stages take a ``HarvestParams`` so every constant
can be overridden per run.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES (must stay equal to the reproduced behaviour)
# ---------------------------------------------------------------------------

# Instruction templates, in order; "{topic}" is replaced by the page host.
INSTRUCTION_TEMPLATES = [
    "As a Senior Cloud Security Architect, explain the concepts regarding {topic}.",
    "What are the security best practices for {topic} based on this documentation?",
    "Design a secure architecture incorporating {topic} using the following reference.",
    "Analyze the compliance implications of {topic}.",
    "What are the risks and mitigations for {topic}?",
    "How would you implement {topic} following Zero Trust principles?",
]

# Default crawl seeds, in queue order.
SEED_URLS = [
    "https://docs.aws.amazon.com/prescriptive-guidance/latest/security-reference-architecture/welcome.html",
    "https://learn.microsoft.com/en-us/azure/well-architected/security/",
    "https://cloud.google.com/architecture/framework/security",
    "https://kubernetes.io/docs/concepts/security/",
    "https://attack.mitre.org/matrices/enterprise/cloud/",
    "https://www.cisecurity.org/controls/cis-controls-list",
]

# Default allow-list of hosts (exact, case-sensitive netloc match).
ALLOWED_DOMAINS = [
    "docs.aws.amazon.com",
    "learn.microsoft.com",
    "cloud.google.com",
    "kubernetes.io",
    "attack.mitre.org",
    "www.cisecurity.org",
]

# System prompt used when rendering training samples.
TRAIN_SYSTEM_PROMPT = (
    "You are a Senior Cloud Security Architect. Provide detailed, secure, "
    "and compliant technical guidance."
)

# System prompt used for the evaluation prompt set.
EVAL_SYSTEM_PROMPT = "You are a Senior Cloud Security Architect."

# Default system prompt for chat / serving prompts.
SERVING_SYSTEM_PROMPT = """You are a Senior Cloud Security Architect. Provide detailed, secure, and compliant technical guidance. Your expertise includes:
- Multi-cloud security architecture (AWS, Azure, GCP)
- Compliance frameworks (NIST 800-53, CIS Benchmarks, ISO 27001)
- Identity and access management (OIDC, SAML, OAuth 2.0)
- Infrastructure-as-Code security (Terraform, CloudFormation)
- Kubernetes and container security
- Zero Trust architecture principles"""

# Evaluation questions ("golden set"), in order.
GOLDEN_QUESTIONS = [
    "Design a multi-region disaster recovery strategy for a financial app on AWS using Route 53 and Aurora Global Database.",
    "Explain the security implications of enabling 'privileged' mode in a Kubernetes container.",
    "Compare the use of Azure Service Endpoints vs. Private Link for securing SQL Database access.",
    "How does OIDC federation differ from SAML 2.0 when integrating Okta with AWS IAM?",
]

# Example prompts offered by the interactive front end, in order.
EXAMPLE_PROMPTS = [
    "What are the key security considerations when designing a multi-region AWS architecture?",
    "Compare Azure Private Endpoints vs Service Endpoints for a healthcare workload.",
    "How should I implement Zero Trust architecture for a hybrid cloud environment?",
    "What Kubernetes security controls are needed for PCI-DSS compliance?",
    "When should I use OIDC vs SAML for enterprise identity federation?",
    "Design a secure CI/CD pipeline with proper secrets management.",
    "What are the best practices for securing Terraform state files?",
    "How do I implement network segmentation in a multi-cloud environment?",
]

# Chat layout markers.
BEGIN_OF_TEXT = "<|begin_of_text|>"
START_HEADER = "<|start_header_id|>"
END_HEADER = "<|end_header_id|>"
END_OF_TURN = "<|eot_id|>"

# Numeric constants of the harvest loop and of training preparation.
MAX_SAMPLES = 5000          # sample budget (counts samples, not pages)
MIN_TEXT_LENGTH = 500       # reject len(text) < 500
MIN_GRADE = 8.0             # reject grade < 8
CHUNK_MAX = 2000            # flush when len(buf) + len(paragraph) >= 2000
CHUNK_MIN = 200             # emit a flushed buffer only if len(buf) > 200
PARAGRAPH_SEP = "\n\n"
NUM_PERM = 128
LSH_THRESHOLD = 0.85
SPLIT_SEED = 42
TEST_SIZE = 0.1
MAX_SEQ_LENGTH = 2048

# Python ``str.split()`` / ``str.strip()`` whitespace, spelled out so the same
# class works in Java regex and in RE2 (which lacks Unicode ``\s``).
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The href pattern of link discovery, and the words before a sample's source in
# the user turn of the chat layout.
HREF_RE = "href=['\"]?([^'\" >]+)"
CONTEXT = "\nContext: "


@functools.cache
def lsh_bands_rows(threshold: float = LSH_THRESHOLD, num_perm: int = NUM_PERM,
                   fp_weight: float = 0.5, fn_weight: float = 0.5) -> tuple[int, int]:
    """Pick (bands, rows) minimising the weighted false-positive/negative
    areas under the LSH S-curve ``1 - (1 - s**r)**b`` (b * r <= num_perm)."""

    def integrate(f, a, b, n=1000):
        h = (b - a) / n
        return sum(f(a + (i + 0.5) * h) for i in range(n)) * h

    best, best_err = (1, num_perm), float("inf")
    for b in range(1, num_perm + 1):
        for r in range(1, num_perm // b + 1):
            fp = integrate(lambda s: 1 - (1 - s ** r) ** b, 0.0, threshold)
            fn = integrate(lambda s: 1 - (1 - (1 - s ** r) ** b), threshold, 1.0)
            err = fp_weight * fp + fn_weight * fn
            if err < best_err:
                best, best_err = (b, r), err
    return best


@dataclass(frozen=True)
class HarvestParams:
    max_samples: int = MAX_SAMPLES
    min_length: int = MIN_TEXT_LENGTH
    min_grade: float = MIN_GRADE
    chunk_max: int = CHUNK_MAX
    chunk_min: int = CHUNK_MIN
    sep: str = PARAGRAPH_SEP
    emit_tail: bool = False      # True: also emit the last buffer
    glue_bug: bool = True        # False: keep the separator after a flush
    num_perm: int = NUM_PERM
    threshold: float = LSH_THRESHOLD
    seed: int = SPLIT_SEED
    templates: tuple = field(default_factory=lambda: tuple(INSTRUCTION_TEMPLATES))
    # stages that can be replaced; None: the built-in one.  Column -> Column
    extractor: Callable | None = None    # html -> text
    grader: Callable | None = None       # text -> grade
    # (instruction, input, output) -> training text, and text -> number of tokens
    formatter: Callable | None = None
    token_counter: Callable | None = None

    @property
    def bands(self) -> int:
        return lsh_bands_rows(self.threshold, self.num_perm)[0]

    @property
    def rows(self) -> int:
        return lsh_bands_rows(self.threshold, self.num_perm)[1]
