"""Run configuration: driver-side records with checks, from and to YAML."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

# Fixed values.
LANGS = ("en", "hi", "hi-en")
FRAMEWORKS = ("mem0", "letta", "amem", "mock")
MITIGATIONS = ("none", "normalize", "xling_er")
BACKENDS = ("ollama", "vllm")
#: Names of hosted providers, which no address of a model may hold.
DENIED_PROVIDERS = ("openai", "anthropic", "cohere", "gemini", "groq", "together", "fireworks", "deepseek")


def _check(ok: bool, name: str, value: object) -> None:
    if not ok:
        raise ValueError(f"{name} is out of range: {value!r}")


@dataclass
class Model:
    name: str = "qwen2.5:7b-instruct"
    quantization: str = "q4_K_M"
    temperature: float = 0.0
    backend: str = "ollama"
    base_url: str = "http://localhost:11434"

    def __post_init__(self) -> None:
        _check(0 <= self.temperature <= 2, "temperature", self.temperature)
        _check(self.backend in BACKENDS, "backend", self.backend)
        _check(allowed_url(self.base_url), "base_url", self.base_url)


@dataclass
class Languages:
    store: str = "hi"
    probe: str = "en"

    def __post_init__(self) -> None:
        _check(self.store in LANGS, "store", self.store)
        _check(self.probe in LANGS, "probe", self.probe)


@dataclass
class Benchmark:
    fact_bank: str = "data/facts_v1.yaml"
    n_facts: int = 250
    filler_sessions: int = 3
    distractor_ratio: float = 0.3

    def __post_init__(self) -> None:
        _check(self.n_facts > 0, "n_facts", self.n_facts)
        _check(self.filler_sessions >= 0, "filler_sessions", self.filler_sessions)
        _check(0 <= self.distractor_ratio <= 1, "distractor_ratio", self.distractor_ratio)


@dataclass
class RunConfig:
    experiment: str
    framework: str = "mock"
    model: Model = field(default_factory=Model)
    embedder: str = "BAAI/bge-m3"
    languages: Languages = field(default_factory=Languages)
    benchmark: Benchmark = field(default_factory=Benchmark)
    mitigation: str = "none"
    seeds: list[int] = field(default_factory=lambda: [11, 22, 33])
    output_dir: str = "runs/experiment_default"

    def __post_init__(self) -> None:
        for name, kind in (("model", Model), ("languages", Languages), ("benchmark", Benchmark)):
            if isinstance(part := getattr(self, name), dict):
                known = {f.name for f in fields(kind)}
                setattr(self, name, kind(**{k: v for k, v in part.items() if k in known}))
        _check(self.framework in FRAMEWORKS, "framework", self.framework)
        _check(self.mitigation in MITIGATIONS, "mitigation", self.mitigation)
        _check(len(self.seeds) >= 1, "seeds", self.seeds)

    @classmethod
    def from_yaml(cls, path: str) -> RunConfig:
        import yaml

        if not Path(path).exists():
            raise FileNotFoundError(f"no configuration at {path}")
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in yaml.safe_load(Path(path).read_text(encoding="utf-8")).items() if k in known})

    def to_yaml(self, path: str) -> None:
        import yaml

        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(yaml.safe_dump(asdict(self), sort_keys=False), encoding="utf-8")


def allowed_url(url: str) -> bool:
    """Whether a model's address names none of the hosted providers."""
    return not any(name in url.lower() for name in DENIED_PROVIDERS)
