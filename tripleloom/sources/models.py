"""Models that Python workers call: a chat endpoint and a local text encoder."""

from __future__ import annotations

import json
import logging
import time
import urllib.error
import urllib.request
from concurrent.futures import ThreadPoolExecutor

import numpy as np


class HttpModel:
    """Answers of a chat endpoint, None for a call that failed; fits the Validator protocol.

    A batch's calls run side by side, `together` at a time. A call that the server is too busy for, or
    that does not get through, is tried again, with a pause that doubles.
    """

    def __init__(
        self, base_url: str, model: str, temperature: float = 0.0, max_tokens: int = 500, timeout: float = 60, tries: int = 3,
        pause: float = 1.0, together: int = 8
    ):
        self.url, self.model, self.options = base_url.rstrip("/") + "/chat/completions", model, {"temperature": temperature, "max_tokens": max_tokens}
        self.timeout, self.tries, self.pause, self.together = timeout, tries, pause, together

    def one(self, prompt: str) -> str:
        asked = json.dumps({"model": self.model, "messages": [{"role": "user", "content": prompt}], **self.options}).encode()
        for k in range(self.tries):
            try:
                request = urllib.request.Request(self.url, asked, {"Content-Type": "application/json"})
                with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                    return json.load(reply)["choices"][0]["message"]["content"]
            except urllib.error.HTTPError as e:
                if k == self.tries - 1 or e.code < 500 and e.code != 429:
                    raise
            except OSError:
                if k == self.tries - 1:
                    raise
            time.sleep(self.pause * 2**k)
        raise ValueError("tries must be 1 or more")

    def _answer(self, prompt: str) -> str | None:
        try:
            return self.one(prompt)
        except Exception:  # a failed call costs its own row
            logging.getLogger(__name__).exception("no answer from %s", self.url)
            return None

    def answer(self, prompts: list[str]) -> list[str | None]:
        with ThreadPoolExecutor(self.together) as pool:
            return list(pool.map(self._answer, prompts))


class TransformerEmbedder:
    """Unit vectors of a local encoder: masked mean, or the last token for models named so. Needs torch and transformers."""

    def __init__(self, name: str, batch: int = 32, longest: int = 512):
        import torch
        from transformers import AutoModel, AutoTokenizer

        self.torch, self.batch, self.longest, self.last = torch, batch, longest, "Embedding" in name
        self.device = "cuda" if torch.cuda.is_available() else "cpu"
        self.tokenizer = AutoTokenizer.from_pretrained(name, padding_side="left" if self.last else "right")
        self.model = AutoModel.from_pretrained(name).to(self.device).eval()

    def embed(self, texts: list[str]) -> np.ndarray:
        out = []
        for k in range(0, len(texts), self.batch):
            given = self.tokenizer(
                texts[k : k + self.batch], padding=True, truncation=True, max_length=self.longest, return_tensors="pt"
            ).to(self.device)
            with self.torch.no_grad():
                state = self.model(**given).last_hidden_state.float().cpu().numpy()
            mask = given["attention_mask"].cpu().numpy()[:, :, None]
            out.append(state[:, -1] if self.last else (state * mask).sum(1) / np.maximum(mask.sum(1), 1e-9))
        found = np.concatenate(out) if out else np.zeros((0, 1), np.float32)
        return (found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)).astype(np.float32)
