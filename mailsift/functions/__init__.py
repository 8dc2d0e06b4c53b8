from mailsift.functions import addresses, dates, scores, seeded, text, urls

__all__ = ["addresses", "dates", "scores", "seeded", "text", "urls"]
