import random

import pytest


@pytest.fixture(scope="session")
def labeller():
    """The page labeller, trained once on the generator's pages."""
    from cognate_spark.llm import html_extract

    r = random.Random(5)
    return html_extract.trained([html_extract._invented_page(html_extract.invented(r)) for _ in range(html_extract.INVENTED)])
